"""A full-text index that is kept: tables of postings in segments, which queries read by term and updates never rewrite.

Under a root folder (all Parquet):

- `postings/seg=S/bucket=B`: field, term, chunk, most_tf, least_length, posts, docs, sorted by term: what a chunk's documents hold of
  a term, and what bounds their scores. chunk is doc_id / 2^CHUNK; a post is the rest of a doc_id and, from bit CHUNK on, the
  occurrences. A term's bucket is its hash modulo the number of buckets, so a query opens only the folders of its terms. A term of
  a chunk can have several rows. The term '' (no word) lists every document in docs too (null for other terms): doc_id, length of
  the field, source, published_at, to score, choose and order what is found and to take a replaced document out of the statistics.
- `dead/seg=S`: doc_id of documents replaced or deleted in segment S; their postings of earlier segments count no more.
- `stats/seg=S`: field, n, words: what the segment adds to (or takes from) the numbers of documents and words.
- `commits/seg=S`: written last; segments without it do not exist for readers, so a failed update leaves nothing behind but
  files. A compaction's commit names the segments that it stands for; `vacuum` deletes those.

One writer at a time. Rows with a null doc_id are left out; null fields hold no words; of several rows of one doc_id in one
update the last published counts (ties: the greatest source and texts).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.stemming import BEFORE, PRONOUNS, VERBS, V, AMENTE, AZIONE, ENZA, ITA, IVO, LOGIA, MENTO, PLAIN, UZIONE, italian_stems
from newsloom.operators.search import ASKED, B, FIELDS, FORMS, K1, ORACLE_SQL as SEARCH_SQL, search_tokens
from newsloom.sources import store
from newsloom.sources.domain import Domain

BUCKETS, CHUNK = 64, 10
#: Chunks that a search without a total scores first, to learn what the others must reach.
FIRST_CHUNKS = 16
#: Chunks with documents that were replaced or deleted go to every task up to this number (each with a bit a document, 400 bytes at most).
BROADCAST_GONE = 100_000
#: Words that a task counts at once, about.
COUNTED = 1 << 20
#: The distinct words of an update go to every task with their terms up to this number (some 50 bytes each).
BROADCAST_WORDS = 500_000
_SCHEMAS = {
    "postings": "field string, term string, chunk long, most_tf long, least_length long, posts array<long>, docs array<struct<doc_id: long, length: long, source: string, published_at: timestamp>>, seg int, bucket int",
    "dead": "doc_id long, seg int",
    "stats": "field string, n long, words long, seg int",
    "commits": "covers array<int>, seg int",
}


def _slices(chunks: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows, cut between chunks, with about COUNTED words each."""
    edges = np.append(np.flatnonzero(np.diff(chunks)) + 1, len(chunks))
    group = np.append(0, np.cumsum(words))[edges] // COUNTED
    ends = edges[np.append(np.flatnonzero(np.diff(group)), len(group) - 1)]
    return zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)


def _counter(forms: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (chunk, doc_id, source, published_at, field, words: words joined by spaces), best by chunk, to postings."""
    read_as = pa.array(list(forms), pa.string())

    def counted(rows: pa.RecordBatch, field: str) -> Iterator[pa.RecordBatch]:
        m, texts = rows.num_rows, rows["words"]
        chunk, rest = np.asarray(rows["chunk"]), np.asarray(rows["doc_id"]) & (1 << CHUNK) - 1
        split = pc.split_pattern(texts, " ")
        some = np.asarray(pc.not_equal(texts, ""))  # no text has one empty word
        length = np.where(some, np.asarray(pc.list_value_length(split)), 0).astype(np.int64)
        words = pc.list_flatten(split.filter(pa.array(some)))
        found = words.dictionary_encode()
        index, terms = np.asarray(found.indices).astype(np.int64), found.dictionary
        if pc.any(pc.is_in(terms, read_as)).as_py():
            again = pa.array([forms.get(w, w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
            index, terms = np.asarray(again.indices).astype(np.int64)[index], again.dictionary
        keys, tf = np.unique(index * m + np.repeat(np.arange(m), length), return_counts=True)
        for term, row, tf in ((None, np.arange(m), np.ones(m, np.int64)), (*np.divmod(keys, m), tf)):
            if not len(row):
                continue
            new = np.diff(chunk[row]) != 0
            starts = np.flatnonzero(np.append(True, new if term is None else new | (np.diff(term) != 0)))
            offsets, k = pa.array(np.append(starts, len(row)).astype(np.int32)), len(starts)
            docs = pa.StructArray.from_arrays([rows["doc_id"], pa.array(length), rows["source"], rows["published_at"]], ["doc_id", "length", "source", "published_at"])
            yield pa.RecordBatch.from_arrays([
                pa.repeat(field, k), pa.repeat("", k) if term is None else terms.take(pa.array(term[starts])), pa.array(chunk[row[starts]]),
                pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length[row], starts)), pa.ListArray.from_arrays(offsets, pa.array(rest[row] | tf << CHUNK)),
                pa.ListArray.from_arrays(offsets, docs) if term is None else pa.nulls(k, pa.list_(docs.type)),
            ], ["field", "term", "chunk", "most_tf", "least_length", "posts", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for a, b in _slices(np.asarray(batch["chunk"]), np.asarray(pc.count_substring(batch["words"], " "))):
                    part = batch.slice(a, b - a)
                    for field in pc.unique(part["field"]).to_pylist():
                        yield from counted(part.filter(pc.equal(part["field"], field)), field)

    return count


def _word(x: Column) -> Column:
    """Which 64 documents of its chunk a doc_id or post is of."""
    return F.shiftright(x.bitwiseAND((1 << CHUNK) - 1), 6).cast("int")


class SearchIndex:
    """An index under `root` over the named text fields. stopwords, forms, stem and buckets must be the same for every use of a root;
    stem(words, column, out) adds the stems of a column of words to a table, for words without a form."""

    def __init__(self, spark: SparkSession, root: str, fields: tuple[str, ...], stopwords: tuple[str, ...] = (), forms: dict[str, str] | None = None,
                 stem: Callable[[DataFrame, str, str], DataFrame] | None = None, buckets: int = BUCKETS):
        self.buckets = buckets
        self.spark, self.root, self.fields, self.stopwords = spark, root, fields, stopwords
        self.forms, self.stem = forms or {}, stem

    def _terms(self, words: DataFrame) -> DataFrame:
        """word, term of the distinct words of a table (word): the form that a word is read as, else its stem, else itself."""
        words = words.distinct()
        words = self.stem(words, "word", "term") if self.stem else words.withColumn("term", F.col("word"))
        return words.withColumn("term", self._form(F.col("word"), F.col("term")))

    def _form(self, word: Column, term: Column) -> Column:
        """The form that a word is read as, else the term."""
        if not self.forms:
            return term
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in self.forms.items() for x in kv]), word), term)

    def _all(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(_SCHEMAS[name])
        path = f"{self.root}/{name}"
        return reader.parquet(path) if store.exists(self.spark, path) else self.spark.createDataFrame([], _SCHEMAS[name])

    def segments(self) -> list[int]:
        """Committed segments that no compaction stands for, ascending."""
        rows = self._all("commits").collect()  # one row a segment
        covered = {s for r in rows for s in r["covers"]}
        return sorted(r["seg"] for r in rows if r["seg"] not in covered)

    def _read(self, name: str) -> DataFrame:
        return self._all(name).where(F.col("seg").isin(self.segments()))

    def _next(self) -> int:
        names = [n for t in ("commits", "postings", "dead", "stats") for n in store.children(self.spark, f"{self.root}/{t}")]
        return max([int(n.removeprefix("seg=")) for n in names if n.startswith("seg=")], default=0) + 1

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows of postings without the documents that a later segment replaced or deleted."""
        dead, segments = self._read("dead").select("doc_id", F.col("seg").alias("until")), self.segments()
        # of every chunk and segment the documents that no longer count there, as bits of 64 ids each
        each = dead.withColumn("chunk", F.shiftright("doc_id", CHUNK)).withColumn("seg", F.explode(F.array(*map(F.lit, segments)))).where("seg < until")
        bits = each.groupBy("chunk", "seg", _word(F.col("doc_id")).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(doc_id & 63 AS int))")).alias("b"))
        words = F.map_from_entries(F.collect_list(F.struct("w", "b")))
        gone = bits.groupBy("chunk", "seg").agg(words.alias("words")).select(
            "chunk", "seg", F.transform(F.sequence(F.lit(0), F.lit((1 << CHUNK - 6) - 1)), lambda i: F.coalesce(F.try_element_at("words", i), F.lit(0).cast("long"))).alias("gone"))
        count = gone.count() if segments else 0
        if not count:
            return rows
        joined = rows.join(F.broadcast(gone) if count <= BROADCAST_GONE else gone, ["chunk", "seg"], "left")
        lives = lambda x: F.getbit(F.get("gone", _word(x)), x.bitwiseAND(63).cast("int")) == 0
        left = {"posts": F.filter("posts", lives), "docs": F.filter("docs", lambda d: lives(d["doc_id"]))}
        cut = {c: F.when(F.col("gone").isNull(), F.col(c)).otherwise(x) for c, x in left.items()}  # bounds stay: they hold for what is left
        return joined.withColumns(cut).where(F.size("posts") > 0).select(*rows.columns)

    def _commit(self, seg: int, covers: list[int]) -> None:
        store.listed(self.spark, [(covers,)], "covers array<int>").coalesce(1).write.parquet(f"{self.root}/commits/seg={seg}")

    def _write_postings(self, postings: DataFrame, seg: int) -> None:
        """postings as the table has them, written as they are dealt."""
        dealt = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).sortWithinPartitions("bucket", "term", "field", "chunk")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/postings/seg={seg}")

    def _documents(self, rows: DataFrame) -> DataFrame:
        """chunk, field, doc_id, length, source, published_at of the documents of rows of postings."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit("")), F.lit(self.buckets)).cast("int")).first()[0]
        return rows.where((F.col("bucket") == bucket) & (F.col("term") == "")).select("chunk", "field", F.explode("docs").alias("d")).select("chunk", "field", "d.*")

    def _lost(self, ids: DataFrame) -> DataFrame:
        """doc_id, field, length of the living documents among ids."""
        return self._documents(self._alive(self._read("postings"))).select("doc_id", "field", "length").join(ids, "doc_id", "left_semi")

    def _write_stats(self, new: DataFrame | None, lost: DataFrame, seg: int) -> None:
        """new, lost: doc_id, field, length."""
        count = lambda df, sign: df.groupBy("field").agg((F.count("*") * sign).alias("n"), (F.sum("length") * sign).alias("words"))
        both = count(lost, -1) if new is None else count(new, 1).unionByName(count(lost, -1))
        both.groupBy("field").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).coalesce(1).write.parquet(f"{self.root}/stats/seg={seg}")

    def replace(self, docs: DataFrame) -> int:
        """Write documents (doc_id, source, published_at, the fields), in place of those of the same doc_id. The new segment."""
        seg = self._next()
        rest = ["published_at", "source", *self.fields]
        # dealt once by chunk: documents, their terms and the chunks' postings are all found in the one task that has the chunk
        own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *rest).withColumn("chunk", F.shiftright("doc_id", CHUNK))
        own = own.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "chunk").groupBy("chunk", "doc_id").agg(F.max(F.struct(*rest)).alias("r")).sortWithinPartitions("chunk", "doc_id")
        read = own.select("chunk", "doc_id", "r.source", F.col("r.published_at").cast("timestamp").alias("published_at"), *[search_tokens(F.col(f"r.{f}"), self.stopwords).alias(f) for f in self.fields])
        each = F.explode(F.create_map(*[x for f in self.fields for x in (F.lit(f), F.col(f))])).alias("field", "words")
        key = ["chunk", "doc_id", "source", "published_at", "field"]
        words = read.select(*key[:-1], each)
        if self.stem:
            words = words.select(*key, F.explode_outer("words").alias("word"))
            terms = store.once(self._terms(words.select("word").where("word IS NOT NULL")), f"{self.root}/terms/seg={seg}")
            terms = F.broadcast(terms) if terms.count() <= BROADCAST_WORDS else terms
            words = words.join(terms, "word", "left").groupBy(*key).agg(F.collect_list(F.coalesce("term", "word")).alias("words")).sortWithinPartitions("chunk", "doc_id")
        # words have neither spaces nor signs; one text a row passes to Python faster than its words
        texts = words.select(*key, F.array_join("words", " ").alias("words"))
        schema = ", ".join(c for c in _SCHEMAS["postings"].split(", ") if c.split()[0] not in ("seg", "bucket"))
        postings = texts.mapInArrow(_counter({} if self.stem else self.forms), schema)
        self._write_postings(postings, seg)
        written = self.spark.read.schema(_SCHEMAS["postings"]).parquet(f"{self.root}/postings").where(F.col("seg") == seg)
        new = self._documents(written).select("doc_id", "field", "length")
        lost = store.once(self._lost(new.select("doc_id").distinct()), f"{self.root}/lost/seg={seg}")
        lost.select("doc_id").distinct().write.parquet(f"{self.root}/dead/seg={seg}")
        self._write_stats(new, lost, seg)
        self._commit(seg, [])
        for name in ("terms", "lost"):
            store.delete(self.spark, f"{self.root}/{name}/seg={seg}")
        return seg

    def delete(self, ids: DataFrame) -> int:
        """Take the documents of ids (doc_id) out. The new segment."""
        seg = self._next()
        lost = store.once(self._lost(ids.select("doc_id").distinct()), f"{self.root}/lost/seg={seg}")
        lost.select("doc_id").distinct().write.parquet(f"{self.root}/dead/seg={seg}")
        self._write_stats(None, lost, seg)
        self._commit(seg, [])
        store.delete(self.spark, f"{self.root}/lost/seg={seg}")
        return seg

    def compact(self) -> int:
        """One segment of all that lives, in place of the segments so far; their files stay until `vacuum`."""
        seg, old = self._next(), self.segments()
        self._write_postings(self._alive(self._read("postings")).drop("seg", "bucket"), seg)
        self._read("stats").groupBy("field").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).coalesce(1).write.parquet(f"{self.root}/stats/seg={seg}")
        self._commit(seg, old)
        return seg

    def vacuum(self) -> None:
        """Delete the files of segments that a compaction stands for, and of updates that failed. Their commits go last."""
        living = {f"seg={s}" for s in self.segments()}
        for name in ("postings", "dead", "stats", "terms", "lost", "commits"):
            for child in store.children(self.spark, f"{self.root}/{name}"):
                if child.startswith("seg=") and child not in living:
                    store.delete(self.spark, f"{self.root}/{name}/{child}")

    def query_terms(self, query: str) -> list[str]:
        """The distinct terms of a query, read as texts are."""
        words = self.spark.range(1).select(F.explode(search_tokens(F.lit(query), self.stopwords)).alias("word"))
        return sorted({r["term"] for r in self._terms(words).collect()})

    def _of_terms(self, name: str, terms: list[str]) -> DataFrame:
        """Rows of some terms; opens only their buckets."""
        buckets = store.listed(self.spark, [(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.buckets)).cast("int")).distinct().collect()
        return self._read(name).where(F.col("bucket").isin([b[0] for b in buckets]) & F.col("term").isin(terms))

    def _weights(self, fields: dict[str, float]) -> DataFrame:
        """field, weight, n, avg_length: a row a field."""
        named = reduce(DataFrame.unionByName, [self.spark.range(1).select(F.lit(f).alias("field"), F.lit(float(w)).alias("weight")) for f, w in fields.items()])
        stats = self._read("stats").groupBy("field").agg(F.sum("n").alias("docs"), (F.sum("words") / F.sum("n")).alias("avg_length"))
        return named.join(stats, "field")

    @staticmethod
    def _part(tf: Column | str, length: Column | str) -> Column:
        """What tf occurrences in a field of that length add to the score."""
        tf, length = (F.col(c) if isinstance(c, str) else c for c in (tf, length))
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return F.col("weight") * (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_length"))))

    def search(self, query: str, fields: dict[str, float], sources: list[str] | None = None, limit: int = 20, offset: int = 0, total: bool = True) -> DataFrame:
        """doc_id, score, and with total how many documents there are in all: a page of the documents that hold a term of the
        query in one of the fields, by weighted BM25 (ties: newest, then doc_id).

        A blank query, one of stop words only, and an empty list of sources find nothing; None asks all sources. limit is
        bounded to 1 to 50, offset to 1,000. Without total, chunks whose bounds stay below what the page needs are
        not scored.
        """
        limit, offset = min(max(limit, 1), 50), min(max(offset, 0), 1000)
        terms = self.query_terms(query)
        if not terms or sources == []:
            none = self.spark.createDataFrame([], "doc_id long, score double, total long")
            return none if total else none.drop("total")
        blocks = self._alive(self._of_terms("postings", terms).where(F.col("field").isin(list(fields))))
        weights = F.broadcast(self._weights(fields))
        df = blocks.groupBy("field", "term").agg(F.sum(F.size("posts")).alias("df"))
        about = F.broadcast(df.join(weights, "field"))  # a row for each field and term of the query
        postings = blocks.select("field", "term", "chunk", F.explode("posts").alias("p")).select(
            "field", "term", "chunk", (F.shiftleft("chunk", CHUNK) + F.col("p").bitwiseAND((1 << CHUNK) - 1)).alias("doc_id"), F.shiftright("p", CHUNK).alias("tf"))
        documents = self._documents(self._alive(self._of_terms("postings", [""]).where(F.col("field").isin(list(fields)))))
        documents = documents if sources is None else documents.where(F.col("source").isin(sources))

        def hits(rows: DataFrame) -> DataFrame:
            rows = rows.join(about, ["field", "term"]).join(documents, ["chunk", "field", "doc_id"])
            return rows.groupBy("doc_id").agg(F.round(F.sum(self._part("tf", "length")), 6).alias("score"), F.max("published_at").alias("t"))

        order = [F.desc("score"), F.desc("t"), "doc_id"]
        if total:
            found = hits(postings)
            page = found.orderBy(*order).offset(offset).limit(limit)
            return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total")))).select("doc_id", "score", "total")
        bounds = blocks.select("field", "term", "chunk", "most_tf", "least_length").join(about, ["field", "term"]).groupBy("chunk", "field", "term").agg(F.max(self._part("most_tf", "least_length")).alias("most"))
        bounds = bounds.groupBy("chunk").agg((F.sum("most") + 1e-5).alias("most"))  # scores are rounded to six places
        first = [r["chunk"] for r in bounds.orderBy(F.desc("most"), "chunk").limit(FIRST_CHUNKS).collect()]
        best = hits(postings.where(F.col("chunk").isin(first))).orderBy(*order).limit(offset + limit).select("score").collect()
        least = best[-1]["score"] if len(best) == offset + limit else float("-inf")
        some = bounds.where(F.col("most") >= least).select("chunk")
        if some.count() <= 10_000:  # their numbers go along; beyond it they are joined
            some = F.broadcast(some)
        return hits(postings.join(some, "chunk", "left_semi")).orderBy(*order).offset(offset).limit(limit).select("doc_id", "score")


def _articles(d: Domain) -> DataFrame:
    return d.texts().withColumn("published_at", F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("doc_id") % 97) * 3600))


def built(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """An index of all documents that went through every kind of update: a third was first written with other texts and then
    replaced, documents that do not exist were written and deleted, the first segments were compacted."""
    docs = _articles(Domain(spark, sf_dir))
    index = SearchIndex(spark, store.work_folder(spark, "search"), tuple(FIELDS), ("the",), FORMS, buckets=8)
    wrong = docs.where("doc_id % 3 = 0")
    index.replace(docs.where("doc_id % 3 <> 0").unionByName(wrong.withColumn("title", F.lit("edges with ble")).withColumn("body", F.upper("title"))))
    gone = docs.withColumn("doc_id", -F.col("doc_id") - 1)
    index.replace(gone)
    index.compact()
    index.delete(gone)
    index.replace(wrong)
    index.vacuum()
    return index


def _followed(spark: SparkSession, sf_dir: str) -> list[str]:
    """Three sources that a user follows."""
    return [r["source"] for r in Domain(spark, sf_dir).table("documents").select("source").distinct().orderBy("source").limit(3).collect()]


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).search(ASKED, FIELDS, _followed(spark, sf_dir), 40, 5)


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = built(spark, sf_dir)
    index.compact()
    return index.search(ASKED, FIELDS, _followed(spark, sf_dir), 40, 5, total=False)


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Domain(spark, sf_dir).table("documents").select(F.explode(search_tokens(F.col("text"))).alias("word")).distinct()
    return italian_stems(words)


QUERIES = {"search_kept_index": _kept, "search_block_maxima": _pruned, "italian_stems": _stems}
_REGION = "CASE WHEN regexp_matches(w, '{0}') THEN length(regexp_extract(w, '{0}')) ELSE length(w) END + 1"
_END = "regexp_extract({}, '(?:{})$')"


def _stems_sql() -> str:
    """The steps of italian_stems as one select each: every select adds what the next one needs."""
    count = 0
    steps = ["""s0 AS (SELECT DISTINCT word, regexp_replace(translate(word, 'áéíóú', 'àèìòù'), 'qu', 'qU', 'g') AS w0
  FROM (SELECT unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]{2,})', 1)) AS word FROM documents))""",
             f"s1 AS (SELECT word, replace(replace(regexp_replace(w0, '([{V}])([ui])([{V}])', '\\1<\\2\\3', 'g'), '<i', 'I'), '<u', 'U') AS w FROM s0)",
             "s2 AS (SELECT *, " + ", ".join(f"{_REGION.format(p)} AS {r}" for r, p in BEFORE.items()) + " FROM s1)"]

    def add(select: str) -> None:
        nonlocal count
        steps.append(f"t{count} AS (SELECT {select} FROM {'s2' if count == 0 else f't{count - 1}'})")
        count += 1

    def cut(pattern: str, region: str, where: str = "true") -> None:
        add(f"* EXCLUDE (hit), ({where}) AND {_END.format('w', pattern)} <> '' AND length(w) - length({_END.format('w', pattern)}) + 1 >= {region} AS hit")
        add(f"* REPLACE (CASE WHEN hit THEN left(w, length(w) - length({_END.format('w', pattern)})) ELSE w END AS w)")

    add(f"*, false AS hit, left(w, length(w) - length(regexp_extract(w, '{PRONOUNS}'))) AS base")
    add("""* REPLACE (CASE WHEN base <> w AND regexp_matches(base, '[ae]ndo$') AND length(base) - 3 >= rv THEN base
  WHEN base <> w AND regexp_matches(base, '[aei]r$') AND length(base) - 1 >= rv THEN base || 'e' ELSE w END AS w)""")
    kinds = {"plain": PLAIN, "azione": AZIONE, "logia": LOGIA, "uzione": UZIONE, "enza": ENZA, "mento": MENTO, "amente": AMENTE, "ita": ITA, "ivo": IVO}
    add(f"*, {_END.format('w', '|'.join(kinds.values()))} AS ending")
    add("*, CASE " + " ".join(f"WHEN regexp_full_match(ending, '{p}') THEN '{k}'" for k, p in kinds.items()) + " END AS kind")
    add("*, coalesce(kind IS NOT NULL AND length(w) - length(ending) + 1 >= CASE kind WHEN 'mento' THEN rv WHEN 'amente' THEN r1 ELSE r2 END, false) AS done")
    add("* REPLACE (CASE WHEN done THEN left(w, length(w) - length(ending)) || CASE kind WHEN 'logia' THEN 'log' WHEN 'uzione' THEN 'u' WHEN 'enza' THEN 'ente' ELSE '' END ELSE w END AS w)")
    cut("ic", "r2", "done AND kind = 'azione'")
    cut("abil|ic|iv", "r2", "done AND kind = 'ita'")
    cut("iv", "r2", "done AND kind = 'amente'")
    add("*, hit AS iv")
    cut("at", "r2", "iv")
    cut("os|ic|abil", "r2", "done AND kind = 'amente' AND NOT iv")
    cut("at", "r2", "done AND kind = 'ivo'")
    cut("ic", "r2", "hit")
    add(f"* REPLACE (CASE WHEN done THEN w ELSE left(w, length(w) - length({_END.format('substr(w, rv)', VERBS)})) END AS w)")
    cut("[aeioàèìò]", "rv")
    cut("i", "rv", "hit")
    add("word, CASE WHEN regexp_matches(w, '[cg]h$') AND length(w) - 1 >= rv THEN left(w, length(w) - 1) ELSE w END AS w")
    return f"WITH {', '.join(steps)} SELECT word, translate(w, 'IU', 'iu') AS stem FROM t{count - 1}"


ORACLE_SQL = {
    "search_kept_index": SEARCH_SQL["search_page"],
    "italian_stems": _stems_sql(),
    "search_block_maxima": f"SELECT doc_id, score FROM ({SEARCH_SQL['search_page']})",
}
