"""Mixing sources to target weights with the cube method.

A source's target over its size is the rate at which each of its documents is
taken: the whole part is copies that all get, the rest an inclusion
probability.  The flight phase of the cube method walks the vector of
probabilities through the null-space of two constraints (words and documents),
so both totals stay exact while probabilities become 0 or 1.  It runs in blocks
of bounded size; a block leaves at most two open probabilities, which meet again
in blocks of the next level, until each source has one block.  The landing
settles what is left there, at most two documents of a source.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.llm.rowmarks import CHUNK, FILE, ROW, Placed
from spanlens.llm.storage import materialize
from spanlens.llm.textbytes import map_texts, utf8

WEIGHTS = (3, 1, 2)
BLOCK = 4096
_EDGE = 1e-9


def sizes(rows: DataFrame) -> DataFrame:
    """``(doc_id, source, text, ..long columns)`` to ``(doc_id, source, size, ..)``: words of each whole text."""
    carried = rows.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(t.split()) for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), *batch.columns[3:]], names=["doc_id", "source", "size", *carried])

    return map_texts(rows, run, ", ".join(["doc_id long", "source string", "size long", *(f"{c} long" for c in carried)]))


def _named(id_col: str, source_col: str, text_col: str) -> dict[str, Column]:
    return {"doc_id": F.col(id_col).cast("long"), "source": F.col(source_col).cast("string"), "text": F.col(text_col)}


def targets(measured: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target, n_docs)``: the weights' shares, capped and reshared.

    Sources in order of code points, null last, take ``weights`` in turn.  The
    share of a source is level x weight; one above ``most`` times its size
    stops there and the level of the others rises, until none is above.
    """
    per = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    weight = F.array(*[F.lit(float(w)) for w in weights])
    per = materialize(per.withColumn("weight", weight[place % len(weights)]).withColumn("cap", F.col("source_size") * float(most)), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        at_cap = F.col("weight") * level >= F.col("cap")
        capped, open_weight = per.agg(F.sum(F.when(at_cap, F.col("cap")).otherwise(0.0)), F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        new = (share * total - capped) / open_weight
        if new <= level:
            break
        level = new
    return per.select("source", "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"), "n_docs")


def flight(size: list[int], chance: list[float], random: Random) -> tuple[list[float], list[int]]:
    """Move ``chance`` to 0 or 1 with its sum and its sum by ``size`` kept; the places left open.

    Three open places at a time have a direction that keeps both sums; a step
    along it, forward or backward by lot so that no expectation changes, ends
    where the first of them reaches 0 or 1.
    """
    x = list(chance)
    held: list[int] = []
    for new in range(len(x)):
        if x[new] <= _EDGE or x[new] >= 1 - _EDGE:
            x[new] = float(round(x[new]))
            continue
        held.append(new)
        while len(held) >= 2:
            way = _direction([size[k] for k in held])
            if way is None:
                break
            forward = min((1 - x[k]) / u if u > 0 else -x[k] / u for k, u in zip(held, way) if u)
            backward = min(x[k] / u if u > 0 else (x[k] - 1) / u for k, u in zip(held, way) if u)
            step = forward if random.random() * (forward + backward) < backward else -backward
            still = []
            for k, u in zip(held, way):
                v = x[k] + step * u
                x[k] = 0.0 if v <= _EDGE else 1.0 if v >= 1 - _EDGE else v
                if 0.0 < x[k] < 1.0:
                    still.append(k)
            if len(still) == len(held):  # rounding kept all open
                k = min(held, key=lambda i: min(x[i], 1 - x[i]))
                x[k] = float(round(x[k]))
                still.remove(k)
            held = still
    return x, held


def _direction(s: list[int]) -> list[float] | None:
    if len(s) == 2:
        return [1.0, -1.0] if s[0] == s[1] else None
    a, b, c = s
    scale = float(max(abs(b - c), abs(c - a), abs(a - b)))
    return [1.0, -1.0, 0.0] if scale == 0 else [(b - c) / scale, (c - a) / scale, (a - b) / scale]


def landing(size: list[int], x: list[float], held: list[int], words: float, docs: float) -> None:
    """Settle the open places so that words, then documents, miss the least."""
    best = None
    for pick in range(1 << len(held)):
        take = [(pick >> i) & 1 for i in range(len(held))]
        miss_words = abs(sum((t - x[k]) * size[k] for t, k in zip(take, held)))
        miss_docs = abs(sum(t - x[k] for t, k in zip(take, held)))
        cost = (miss_words / max(words, 1.0) + miss_docs / max(docs, 1.0), pick)
        if best is None or cost < best[0]:
            best = (cost, take)
    for t, k in zip(best[1], held):
        x[k] = float(t)


def _walk(land: bool, seed: int):
    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("mix", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("x", "ascending"), (FILE, "ascending"), (ROW, "ascending")])
        size, x = order.column("size").to_pylist(), order.column("x").to_pylist()
        name = f"{seed}|{order.column('source')[0].as_py()!r}|{order.column('block')[0].as_py()}"
        x, held = flight(size, x, Random(zlib.crc32(name.encode("utf-8", "surrogatepass"))))
        if land and held:
            landing(size, x, held, float(sum(size)), float(len(size)))
        return order.set_column(order.schema.get_field_index("x"), "x", pa.array(x, pa.float64()))

    return run


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, a row for each row of ``docs``.

    ``copies`` (0 to ``most``) is how often the document is taken and ``taken``
    its words times that.  Null sources are a source of their own; null and
    empty texts have size 0 and are taken like others, for 0 words; a source of
    such texts only has target 0 and no copies.  Repeated rows are drawn each.
    The draw depends on the rows and the seed alone, so a rerun agrees.
    """
    named = _named(id_col, source_col, text_col)
    measured = Placed(materialize(sizes(docs.select(*[c.alias(n) for n, c in named.items()])), "sizes"))
    return _mix(measured.select(**{c: F.col(c) for c in ("doc_id", "source", "size")}), weights, share, most, seed, block).drop(FILE, ROW)


def _numbered(measured: DataFrame, block: int) -> DataFrame:
    """Rows with ``piece``: 0, but rows of one source, id and size beyond ``block`` are cut into pieces of ``block``.

    Such rows are numbered within bounded runs of their files, and the runs' offsets are sums of
    counts, so no task sorts a whole group.  The numbers of a group are the same however rows lie.
    """
    like = ["source", "doc_id", "size"]
    hot = measured.groupBy(*like).agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = materialize(hot.select(*[F.col(c).alias(f"hot_{c}") for c in like]), "repeated")
    if hot.isEmpty():
        return measured.withColumn("piece", F.lit(0).cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in like]
    run = [*like, FILE, "chunk"]
    rows = measured.join(hot, same, "left_semi").withColumn("chunk", F.floor(F.col(ROW) / CHUNK))
    counts = rows.groupBy(*run).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*like).orderBy(FILE, "chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(c).alias(f"of_{c}") for c in run], F.coalesce(before, F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy(*run).orderBy(ROW)) - 1
    at = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in run]
    joined = rows.withColumn("number", number).join(offsets, at)
    cut = joined.select(*measured.columns, F.floor((F.col("number") + F.col("offset")) / block).cast("long").alias("piece"))
    rest = measured.join(hot, same, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    return rest.unionByName(cut)


def _mix(measured: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """`mix` of rows ``(doc_id, source, size)`` with places, which it keeps."""
    per = targets(measured, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    per = materialize(per.withColumn("rate", rate), "targets")
    counts = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).cast("int")
    key = F.when(F.col("piece") == 0, F.xxhash64(F.lit(seed), "doc_id", "size")).otherwise(F.xxhash64(F.lit(seed), "doc_id", "size", "piece"))
    known = per.select(F.col("source").alias("of"), "source_size", "target", "rate", counts.alias("blocks"))
    open_rows = _numbered(measured, block).join(known, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.floor("rate").cast("int").alias("base"),
        (F.col("rate") - F.floor("rate")).alias("x"),
        key.alias("mix"),
        F.col("blocks"),
        FILE,
        ROW,
    )
    schema = f"doc_id long, source string, size long, source_size long, target double, base int, x double, mix long, blocks int, {FILE} long, {ROW} long, block int"
    largest = per.agg(F.max(counts)).first()[0] or 1
    done: list[DataFrame] = []
    while True:
        last = largest == 1
        dealt = open_rows.withColumn("block", _deal(F.col("mix"), F.col("blocks"))).select(*[c.split()[0] for c in schema.split(", ")])
        walked = materialize(dealt.groupBy("source", "block").applyInArrow(_walk(last, seed), schema), "walked")
        if last:
            done.append(walked)
            break
        settled = F.col("x").isin(0.0, 1.0)
        done.append(walked.where(settled))
        # two open rows of a block at most go on; hashed anew, so that other rows meet
        following = F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / block)).cast("int")
        open_rows = walked.where(~settled).drop("block").withColumn("blocks", following).withColumn("mix", F.xxhash64("mix", F.lit(largest)))
        largest = max(1, -(-largest * 2 // block))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("base") + F.col("x").cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), FILE, ROW)


def _deal(key: Column, blocks: Column) -> Column:
    return F.pmod(key, blocks).cast("int")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as `mix` takes it, all columns unchanged; texts are not shuffled."""
    rows = Placed(docs)
    measured = materialize(sizes(rows.select(**_named(id_col, source_col, text_col))), "sizes")
    return rows.take(_mix(measured, **options))
