"""Quality classifier: an interpolated modified Kneser-Ney character model of trusted text, and quantiles of perplexity.

The symbols are code points, all of them, so the model's tables grow with the trusted text: Spark sums the n-grams that
tasks count, and each order's discounts, context totals and continuation counts are aggregations and joins of those
tables, which stay tables. A text's perplexity comes from joins of counts too: tasks count each text's distinct n-grams
and send them once a step of about STEP_BYTES of text, with the texts that have them and how often. The distinct n-grams
of all texts are joined to the model's tables, from the highest order down to the first that has them, and the resulting
cost of an n-gram joins the counts; sums by text are its cost. Costs are whole millionths of a nat, so sums are the same
in any order and equal texts have equal perplexities. Costs are broadcast up to COSTS rows, and beyond them the counts are
shuffled by n-gram; the tables of the model are written first, so that Spark broadcasts those below its own threshold.

Trusted texts are all labelled good and not toxic. A text's perplexity is the exponential of its mean negative log
probability a character. For each language, the threshold lies MARGIN times the spread of trusted texts (their quantile
QUANTILE less their median, in log perplexity) above that quantile. Both quantiles of a language with n trusted texts
weigh n / (n + PRIOR) against those of all texts, whatever n is; null languages and those without trusted texts take
the latter. Short texts vary more: the spread is widened by 1 + SHORT / characters.

Null and empty texts have no perplexity and are rejected, with trusted texts or without. Without trusted texts nothing
is known, and every other text is kept. A perplexity equal to the threshold is kept. Repeated rows are judged each.
Empty tables give empty ones. Extra columns, whatever their names, are passed through. A character 0 counts as U+FFFD.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanefold.llm.common import lean, limit_batches, scratch, small, steps, written

ORDER = 4
QUANTILE, MARGIN, SHORT, PRIOR = 0.99, 0.5, 100.0, 50.0
#: Code points there are: what no order has seen is spread over them evenly.
SYMBOLS = 0x110000
#: Costs are whole numbers of this share of a nat.
UNIT = 1e-6
#: Rows of costs (about 80 bytes each) that are broadcast at most; more are joined by a shuffle of the counts.
COSTS = 1_000_000
_PAD = "\n" * (ORDER - 1)  # texts begin after line ends


def _grams(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct n-grams, where each begins in what follows, texts that have it in order, how often they do)."""
    texts = [t.replace("\0", "�") for t in texts]
    points = np.frombuffer((_PAD + _PAD.join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    present = np.zeros(SYMBOLS, dtype=bool)
    present[points] = True
    letters = np.flatnonzero(present)
    if len(letters) ** ORDER * len(texts) >= 1 << 63:  # very many different letters: fewer texts at once
        if len(texts) > 1:
            half = len(texts) // 2
            yield from _grams(texts[:half])
            for g, starts, who, n in _grams(texts[half:]):
                yield g, starts, who + half, n
        else:
            whole = _PAD + texts[0]
            found = Counter(whole[i : i + ORDER] for i in range(len(texts[0])))
            yield list(found), np.arange(len(found)), np.zeros(len(found), np.int64), np.array(list(found.values()))
        return
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.any():
        return
    rank = np.zeros(SYMBOLS, dtype=np.uint32)
    rank[letters] = np.arange(len(letters))
    s = rank[points]
    del points, present, rank
    key = np.zeros(len(s) - ORDER + 1, dtype=np.int64)  # arrays of a step's size: changed in place and dropped early, as a worker holds them all at once
    for i in range(ORDER):
        key *= len(letters)
        key += s[i : len(s) - ORDER + 1 + i]
    del s
    apart = len(_PAD)
    key *= len(texts)
    key += np.repeat(np.arange(len(texts), dtype=np.int32), sizes + apart)[: len(key)]
    over = np.cumsum(sizes + apart)[:-1, None] - np.arange(apart, 0, -1)
    key = np.delete(key, over.ravel())  # a text's first character ends the n-gram that starts at its padding
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(first, append=len(key))
    key = key[first]
    del first
    code, who = np.divmod(key, len(texts))
    del key
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    code, out = code[starts], np.empty((len(starts), ORDER), dtype=np.uint32)
    for i in reversed(range(ORDER)):
        code, at = np.divmod(code, len(letters))
        out[:, i] = letters[at]
    yield out.view(f"<U{ORDER}").ravel().tolist(), starts, who, n


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, seven bits each, low ones first; how many bytes each has)."""
    values = values.astype(np.int64)
    size = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        size += values >> bits > 0
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    rest = np.repeat(values, size) >> 7 * at
    return ((rest & 127) | (rest > 127) * 128).astype(np.uint8), size


def _values(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, index after each one's last byte) of such bytes."""
    ends = np.flatnonzero(data < 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64), ends
    begins = np.concatenate(([0], ends[:-1]))
    at = np.arange(len(data)) - np.repeat(begins, ends - begins)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * at, begins), ends


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a binary column, null as empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _clean(docs: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def counted(trusted: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): counts of the n-grams of highest order over all texts."""
    limit_batches(trusted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text):
            for grams, starts, _, n in _grams(b.column(text).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.add.reduceat(n, starts), pa.int64())], names=["gram", "n"])

    return trusted.select(_clean(trusted, text).alias(text)).mapInArrow(lean(run), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def level(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Modified Kneser-Ney of one order from its (gram, n): (gram, context, alpha) of seen n-grams and (context, gamma).

    alpha is the discounted share of the n-gram in its context, gamma the mass left to the next lower order.
    """
    seen = {int(r["k"]): int(r["m"]) for r in counts.groupBy(F.least("n", F.lit(4)).alias("k")).agg(F.count("*").alias("m")).collect()}
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1, d2, d3 = (min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5)))
    discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    rows = counts.select("gram", F.substring("gram", 1, order - 1).alias("context"), "n", discount.alias("d"))
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
    alpha = rows.join(contexts, "context").select("gram", "context", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"))
    return alpha, contexts.select("context", (F.col("mass") / F.col("total")).alias("gamma"))


def model(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 on, written tables (gram, p) of seen n-grams and (context, gamma); none without text."""
    spark = trusted.sparkSession
    tables = {ORDER: written(counted(trusted), spark)}
    if tables[ORDER].isEmpty():
        return []
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols precede
        tables[k] = written(tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), spark)
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, ORDER + 1):
        alpha, gamma = level(tables[k], k)
        gamma = written(gamma, spark)
        rows = alpha.join(gamma, "context")
        if k == 1:
            rows = rows.withColumn("lower", F.lit(1.0 / SYMBOLS))
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(out[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        out.append((written(rows.select("gram", (F.col("alpha") + F.col("gamma") * F.col("lower")).alias("p")), spark), gamma))
    return out


def costs(docs: DataFrame, levels: list[tuple[DataFrame, DataFrame]], text: str = "text") -> DataFrame:
    """(gram, cost) of all n-grams of all texts: the negative log probability of the last symbol after the others."""
    rows = counted(docs, text).select("gram")
    p: Column = F.lit(1.0 / SYMBOLS)
    for k, (seen, gamma) in enumerate(levels, 1):
        tail = F.substring("gram", ORDER - k + 1, k)
        rows = rows.withColumn("_tail", tail).join(seen.select(F.col("gram").alias("_tail"), F.col("p").alias(f"_p{k}")), "_tail", "left").drop("_tail")
        rows = rows.withColumn("_context", F.substring("gram", ORDER - k + 1, k - 1)).join(gamma.select(F.col("context").alias("_context"), F.col("gamma").alias(f"_g{k}")), "_context", "left").drop("_context")
        p = F.coalesce(F.col(f"_p{k}"), F.coalesce(F.col(f"_g{k}"), F.lit(1.0)) * p)
    return rows.select("gram", F.round(-F.log(p) / UNIT).cast("long").alias("cost"))


def incidences(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """One row for each distinct n-gram of a step, with its texts and counts, and one for each text, with its columns."""
    limit_batches(docs.sparkSession)
    kept = T.StructType([docs.schema[c] for c in keep])
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("step", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("texts", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("row", kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "step", "at", "texts", "counts", "row"]
        for i, b in enumerate(steps(batches, "_text")):
            step, m = TaskContext.get().partitionId() << 32 | i, b.num_rows
            own = b.column("_row")
            yield pa.RecordBatch.from_arrays([pa.array([f"\0{step}/{j}" for j in range(m)], pa.string()), pa.array([step] * m, pa.int64()), pa.array(np.arange(m), pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), own], names=names)
            for grams, starts, who, n in _grams(b.column("_text").to_pylist()):
                for lo in range(0, len(grams), 20_000):  # rows from lo to hi, their texts from a to z
                    hi = min(lo + 20_000, len(grams))
                    a, z = starts[lo], starts[hi] if hi < len(grams) else len(who)
                    begins, k, often = starts[lo:hi] - a, hi - lo, n[a:z] > 1
                    apart = np.diff(who[a:z], prepend=0)
                    apart[begins] = who[a:z][begins]
                    data, size = _varints(apart * 2 + often)
                    many, wide = _varints(n[a:z][often])
                    of_many = np.zeros(z - a, dtype=np.int64)
                    of_many[often] = wide
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grams[lo:hi], pa.string()),
                            pa.array(np.full(k, step), pa.int64()),
                            pa.nulls(k, pa.int32()),
                            _binary(data, np.add.reduceat(size, begins)),
                            _binary(many, np.add.reduceat(of_many, begins)),
                            pa.nulls(k, own.type),
                        ],
                        names=names,
                    )

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), _clean(docs, text).alias("_text")).mapInArrow(lean(run), schema)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(step, at, cost, row): the costs of n-grams times their counts, summed by text as far as a task sees them."""
    sums: dict[int, np.ndarray] = {}
    held, kind = 0, None

    def flushed() -> Iterator[pa.RecordBatch]:
        for step, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), step), pa.int64()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64()), pa.nulls(len(at), kind)], names=["step", "at", "cost", "row"])
        sums.clear()

    for b in batches:
        kind = b.column("row").type
        texts = b.filter(b.column("at").is_valid())
        if texts.num_rows:
            yield pa.RecordBatch.from_arrays([texts.column("step"), texts.column("at"), pa.array(np.zeros(texts.num_rows, np.int64)), texts.column("row")], names=["step", "at", "cost", "row"])
        b = b.filter(b.column("at").is_null())
        if not b.num_rows:
            continue
        data, offsets = _bytes(b.column("texts"))
        value, ends = _values(data)
        of_row = np.searchsorted(ends, offsets, side="right")  # how many values end before each row
        length = np.diff(of_row)
        run = np.cumsum(value >> 1)
        who = run - np.repeat(np.concatenate(([0], run))[of_row[:-1]], length)
        n = np.ones(len(value), dtype=np.int64)
        n[value & 1 == 1] = _values(_bytes(b.column("counts"))[0])[0]
        weight = n * np.repeat(b.column("cost").to_numpy(zero_copy_only=False), length)
        step, place = np.unique(b.column("step").to_numpy(), return_inverse=True)
        most = int(who.max()) + 1
        new = np.bincount(np.repeat(place, length) * most + who, weights=weight, minlength=len(step) * most).astype(np.int64)  # whole numbers far below 2 ** 53
        for i, total in zip(step.tolist(), new.reshape(-1, most)):
            old = sums.get(i)
            if old is not None and len(old) >= most:
                old[:most] += total
                continue
            held += most - (0 if old is None else len(old))
            sums[i] = total.copy()
            if old is not None:
                sums[i][: len(old)] += old
        if held > 2_000_000:
            yield from flushed()
            held = 0
    yield from flushed()


def perplexities(docs: DataFrame, levels: list[tuple[DataFrame, DataFrame]], keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs with _length and perplexity (null where there is no text or no model)."""
    length = F.char_length(_clean(docs, text)).alias("_length")
    if not levels:
        return docs.select(*keep, length, F.lit(None).cast("double").alias("perplexity"))
    found = written(costs(docs, levels, text), docs.sparkSession)
    rows = incidences(docs.select("*", length), [*keep, "_length"], text).join(small(found, COSTS), "gram", "left").select("step", "at", "texts", "counts", "cost", "row")
    row = T.StructField("row", rows.schema["row"].dataType)
    summed = rows.mapInArrow(lean(_summed), T.StructType([T.StructField("step", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("cost", T.LongType()), row]))
    whole = summed.groupBy("step", "at").agg(F.sum("cost").alias("_cost"), F.first("row", ignorenulls=True).alias("row"))
    return whole.select("row.*", "_cost").withColumn("perplexity", F.when(F.col("_length") > 0, F.exp(F.col("_cost") * UNIT / F.col("_length")))).drop("_cost")


def with_trust(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs with _trusted: whether all labels of the id say good and none toxic."""
    ids = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("_trusted")).filter("_trusted")
    return docs.join(small(ids), F.col(doc_id) == F.col("_id"), "left").drop("_id").withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))


def judged(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, by default) of docs with perplexity, threshold and kept.

    Texts are read to train, to list their n-grams and to count these; only what `keep` names is moved.
    """
    spark = docs.sparkSession
    keep = keep or docs.columns
    at = {c: f"_{i}" for i, c in enumerate(docs.columns)} | {"doc_id": "doc_id", "text": "text"}  # names of extra columns can't clash
    own = docs.select([F.col(f"`{c}`").alias(at[c]) for c in docs.columns])
    own = own.withColumn("_lang", F.col(at["lang"]).cast("string") if "lang" in at else F.lit(None).cast("string"))
    need = list(dict.fromkeys(["doc_id", "_lang", *(at[c] for c in keep)]))
    with scratch(spark) as out:
        levels = model(with_trust(own, labels).filter("_trusted").select("text"))
        scored = out(perplexities(own, levels, need))
        trusted = with_trust(scored, labels).filter("_trusted and perplexity is not null").withColumn("_log", F.log("perplexity"))
        quantiles = [F.count("*").alias("_n"), F.percentile_approx("_log", [0.5, QUANTILE], 10_000).alias("_q")]
        whole = trusted.agg(*quantiles).first()
        by_lang = out(trusted.filter("_lang is not null").groupBy("_lang").agg(*quantiles))
    if whole["_n"]:
        scored = scored.join(small(by_lang, 100_000), "_lang", "left")
        weight = F.coalesce(F.col("_n") / (F.col("_n") + PRIOR), F.lit(0.0))
        q = [F.lit(float(x)) + weight * (F.coalesce(F.col("_q")[i], F.lit(float(x))) - float(x)) for i, x in enumerate(whole["_q"])]
        limit = q[1] + MARGIN * (q[1] - q[0]) * (1 + SHORT / F.greatest(F.col("_length"), F.lit(1)))
        scored = scored.withColumn("threshold", F.exp(limit))
        kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    else:
        scored = scored.withColumn("threshold", F.lit(None).cast("double"))
        kept = F.col("_length") > 0
    back = [F.col(at[c]).alias(c) for c in keep if c not in ("perplexity", "threshold", "kept")]
    return scored.withColumn("_kept", kept).select(*back, "perplexity", "threshold", F.col("_kept").alias("kept"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of every document."""
    return judged(docs, labels, ["doc_id", "lang"])


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with the columns they had.

    Equal texts of one language are judged alike, so the rejected ones are told by digest and language.
    """
    spark = docs.sparkSession
    named = docs.select([F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_own{i}") for i, c in enumerate(docs.columns)])
    lang = f"_own{docs.columns.index('lang')}" if "lang" in docs.columns else None
    named = named.withColumn("lang", F.col(lang).cast("string") if lang else F.lit(None).cast("string")).withColumn("_digest", F.md5(_clean(named, "text")))
    with scratch(spark) as out:
        told = judged(named, labels, ["lang", "_digest"])
        gone = out(told.filter("not kept").select(F.col("lang").alias("_l"), F.col("_digest").alias("_d")).distinct())
    left = named.join(gone, (F.col("_digest") == F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l")), "left_anti")
    return left.select([F.col(c if c in ("doc_id", "text") else f"_own{i}").alias(c) for i, c in enumerate(docs.columns)])
