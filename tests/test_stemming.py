"""Stems of a list of Italian words, and of made-up words against the rules followed step by step."""

import random
import re

from newsloom.functions.stemming import italian_stems

KNOWN = """abbandonata abbandon abbandonate abbandon abbandonato abbandon abbandonava abbandon abbandonerà abbandon abbandoneranno abbandon abbandonerò abbandon abbandono abband
abbandonò abbandon abbaruffato abbaruff abbassamento abbass abbassando abbass abbassandola abbass abbassandole abbass abbassar abbass abbassare abbass abbassarono abbass
abbassarsi abbass abbassassero abbass abbassato abbass abbassava abbass abbassi abbass abbassò abbass abbastanza abbast abbatté abbatt abbattendo abbatt abbattere abbatt
abbattersi abbatt abbattesse abbattess abbatteva abbatt abbattevamo abbatt abbattevano abbatt abbattimento abbatt abbattuta abbatt abbattuti abbatt abbattuto abbatt
abbellita abbell abbenché abbenc pronto pront pronuncia pronunc pronunciamento pronunc pronunciare pronunc pronunciarsi pronunc pronunciata pronunc pronunzia pronunz
propaganda propagand propagare propag propaghi propag propensione propension propensioni propension propinò propin propizio propiz propone propon proponendo propon
proponessi proponess proposito propos proposizione proposizion proposta propost proprietà propriet proprietaria proprietar proprio propr prorogata prorog prosa pros
prosciutto prosciutt prosecuzione prosecu proseguimento prosegu proseguendo prosegu città citt attività attiv nazione nazion nazioni nazion nazionale nazional velocemente veloc
economico econom economica econom economici econom amministrazione amministr sindaco sindac governo govern elezioni elezion psicologia psicolog psicologie psicolog
presidenza president conferenze conferent soluzione soluzion attivamente attiv famosamente famos parlare parl parlato parl parlando parl parlarne parl darglielo dargliel
aiuola aiuol gioiosa gioios quando quand guerra guerr amico amic amici amic amiche amic luoghi luog laghi lagh è è di di a a gli gli sport sport"""


def by_rule(word):
    """The rules, one character or ending at a time."""
    v = "aeiouàèìòù"
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    out, i = list(w), 0
    while i + 2 < len(out):
        if out[i] in v and out[i + 1] in "ui" and out[i + 2] in v:
            out[i + 1] = out[i + 1].upper()
            i += 3
        else:
            i += 1
    w = "".join(out)

    def after_first(text, start):
        i = start
        while i < len(text) and text[i] not in v:
            i += 1
        while i < len(text) and text[i] in v:
            i += 1
        return min(i + 1, len(text)) if i < len(text) else len(text)

    r1 = after_first(w, 0)
    r2 = after_first(w, r1)
    rv = len(w)
    if len(w) > 1:
        if w[1] not in v:
            rv = next((k + 1 for k in range(2, len(w)) if w[k] in v), len(w))
        elif w[0] in v:
            rv = next((k + 1 for k in range(2, len(w)) if w[k] not in v), len(w))
        elif len(w) > 2:
            rv = 3

    def longest(text, endings):
        return max((e for e in endings if text.endswith(e)), key=len, default="")

    def cut(w, endings, region):
        e = longest(w, endings)
        return (w[: len(w) - len(e)], True) if e and len(w) - len(e) >= region else (w, False)

    pronouns = "ci gli la le li lo mi ne si ti vi sene".split() + [a + "e" + b for a in ("gli", "m", "t", "c", "v") for b in ("la", "le", "li", "lo", "ne")]
    p = longest(w, pronouns)
    base = w[: len(w) - len(p)]
    if p and (e := longest(base, ["ando", "endo", "ar", "er", "ir"])) and len(base) - len(e) >= rv:
        w = base if len(e) == 4 else base + "e"
    groups = {
        "plain": "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti",
        "azione": "azione azioni atore atori", "log": "logia logie", "u": "uzione uzioni usione usioni", "ente": "enza enze",
        "mento": "amento amenti imento imenti", "amente": "amente", "ita": "ità", "ivo": "ivo ivi iva ive",
    }
    e, kind = max(((x, k) for k, g in groups.items() for x in g.split() if w.endswith(x)), key=lambda t: len(t[0]), default=("", ""))
    done = bool(e) and len(w) - len(e) >= {"mento": rv, "amente": r1}.get(kind, r2)
    if done:
        w = w[: len(w) - len(e)] + (kind if kind in ("log", "u", "ente") else "")
        if kind == "azione":
            w, _ = cut(w, ["ic"], r2)
        elif kind == "ita":
            w, _ = cut(w, ["abil", "ic", "iv"], r2)
        elif kind == "amente":
            w, iv = cut(w, ["iv"], r2)
            w, _ = cut(w, ["at"], r2) if iv else cut(w, ["os", "ic", "abil"], r2)
        elif kind == "ivo":
            w, at = cut(w, ["at"], r2)
            w, _ = cut(w, ["ic"], r2) if at else (w, False)
    else:
        verbs = """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero
            erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste
            iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir""".split()
        tail = longest(w[rv:], verbs)
        w = w[: len(w) - len(tail)]
    w, vowel = cut(w, list("aeioàèìò"), rv)
    if vowel:
        w, _ = cut(w, ["i"], rv)
    if re.search("[cg]h$", w) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")


def stems(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.word: r.stem for r in italian_stems(rows).collect()}


def test_known_words(spark):
    pairs = KNOWN.split()
    true = dict(zip(pairs[::2], pairs[1::2], strict=True))
    assert len(true) >= 100
    assert stems(spark, true) == true == {w: by_rule(w) for w in true}


def test_made_up_words(spark):
    rng = random.Random(6)
    parts = ["a", "e", "i", "o", "u", "qu", "ch", "gh", "b", "gl", "str", "n", "iv", "at", "ic", "abil", "os", "àèìòù"[0], "è", "é"]
    endings = "anza ichi ibile istà mente atrice azione atori logia uzione enze imento amente ità ive ando erebbe iamo isco uto ar andoglielo arsi endone irle sene".split()
    words = {"".join(rng.choices(parts, k=rng.randint(0, 5))) + rng.choice([*endings, ""]) for _ in range(4000)}
    assert stems(spark, words) == {w: by_rule(w) for w in words}


def test_nulls_and_columns(spark):
    rows = spark.createDataFrame([(None, 1), ("", 2), ("città", 3)], "word string, rv int")
    assert sorted((r.rv, r.stem) for r in italian_stems(rows).collect()) == [(1, None), (2, ""), (3, "citt")]
    assert italian_stems(rows.limit(0)).count() == 0
