"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / source size. The running
sum of expected copies inside the source, started at one offset per source, crosses an integer
once for each copy. Documents run in order of size, so each size band gets its share and a
source's words come near the target.

The running sum needs a document's rank in its source. It is put together from three counts, so
no task orders a whole source: documents of smaller sizes (one row per distinct size), documents of
the same size in earlier slices, and the row number inside one slice. Slices are dealt by a hash and there
are so many that about ``slice_rows`` rows of one source and size share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwatch.llm.common import fresh_name


def word_count(text: Column) -> Column:
    r"""Number of runs ``[^\x20\x09-\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, one row per source.

    Sources by code point, null last, take ``weights`` in turn. Together they share ``share`` of all
    words; a target stops at ``max_repeat`` times its source's size and the excess goes to the others
    by weight until none is above. Sources are ordered in one task: there is one row of some 40 bytes for each, so a
    million sources, far more than a mixture names, are 40 MB.
    """
    one = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    everything = Window.partitionBy()
    w = sizes.withColumn("n", F.row_number().over(one)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    )
    w = w.withColumn("cap", F.col("source_size") * max_repeat).withColumn("whole", F.sum("source_size").over(everything) * F.lit(share))
    # the source with the least cap per weight fills first; going up, the level that would fill the rest
    order = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("free", F.col("cap").cast("decimal(19, 0)") * F.col("open") > F.col("left") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("n"), F.col("left"), F.col("open")))).over(everything)
    w = w.withColumn("level", first)
    target = F.when(F.col("free"), F.col("level.left").cast("double") * F.col("weight") / F.col("level.open")).otherwise(F.col("cap").cast("double"))
    return w.select("source", "source_size", "weight", target.alias("target"))


def offset_of(source: Column, seed: str) -> Column:
    """A source's random offset in [0, 1): from an MD5, so reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\u0000null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(
    docs: DataFrame,
    max_repeat: int = 3,
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    seed: str = "mix",
    slice_rows: int = 100_000,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` (or their columns ``carry``, among them doc_id and source) with size, source_size, target (their source's) and copies (0 to ``max_repeat``).

    Null text has size 0, null sources are one source. A source without words gets no copies.
    Ties (equal size and doc_id, repeated rows) take any order among themselves, which changes
    nothing but which of the equal rows counts. Null doc_ids come first. An empty table stays empty. Very long texts count whole.
    The columns doc_id, text and source are read; others ride along, also if they are named like the
    new columns (the new ones then replace them).
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies") and (carry is None or c in carry)]
    src, part, row, before = (fresh_name(docs, n) for n in ("src", "part", "row_no", "rows_before"))
    slices = max(64, -(-docs.count() // slice_rows))
    named = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    of = lambda c: F.struct(F.col(c).isNull().alias("none"), F.coalesce(c, F.lit("")).alias("name"))
    dealt = F.pmod(F.conv(F.substring(named, 1, 8), 16, 10).cast("long"), F.lit(slices)).cast("int")
    d = docs.select(*keep, word_count(F.col("text")).alias("size"), of("source").alias(src), dealt.alias(part))
    cells = d.groupBy(src, "size", part).agg(F.count("*").alias("n"))
    by_size = cells.groupBy(src, "size").agg(F.sum("n").alias("m"))
    up = Window.partitionBy(src).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("smaller", F.coalesce(F.sum("m").over(up), F.lit(0)))
    sizes = by_size.groupBy(src).agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    sizes = sizes.select(F.when(~F.col(f"{src}.none"), F.col(f"{src}.name")).alias("source"), "source_size")
    targets = source_targets(sizes, max_repeat, weights, share).select(of("source").alias(src), "source_size", "target")
    across = Window.partitionBy(src, "size").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("same", F.coalesce(F.sum("n").over(across), F.lit(0))).join(by_size.select(src, "size", "smaller"), [src, "size"])
    cells = cells.join(targets, src).select(src, "size", part, F.expr("smaller + same").alias(before), "source_size", "target")
    inside = Window.partitionBy(src, "size", part).orderBy("doc_id")
    ranked = d.withColumn(row, F.row_number().over(inside) - 1).join(cells, [src, "size", part])
    rank = F.col(before) + F.col(row)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset_of(F.col("source"), seed)
    crossed = F.floor(start + (rank + 1) * each) - F.floor(start + rank * each)
    return ranked.withColumn("copies", F.least(crossed, F.lit(max_repeat)).cast("long")).select(*keep, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row as often as :func:`copies` says, columns as in ``docs``, whatever their names."""
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    taken = copies(packed, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    return copies(docs.select("doc_id", "text", "source"), carry=("doc_id", "source"), **options).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


#: The same in DuckDB SQL.
SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 8))::bigint % (select greatest(64, ceil(count(*) / 100000))::bigint from documents) as slice from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source is null, source::blob) as n from s),
v as (select *, ((n - 1) % 3 + 1)::bigint as weight, source_size * 3 as cap, (sum(source_size) over ())::bigint as whole from w),
x as (select *, whole - coalesce((sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding))::bigint, 0) as rest,
        (sum(weight) over ())::bigint - coalesce((sum(weight) over (order by cap / weight, n rows between unbounded preceding and 1 preceding))::bigint, 0) as open from v),
y as (select *, cap * open > rest * weight as free from x),
z as (select *, first_value(rest) over (order by not free, cap / weight, n) as level_rest, first_value(open) over (order by not free, cap / weight, n) as level_open from y),
t as (select source, source_size, case when free then level_rest::double * weight / level_open else cap::double end as target,
        ('0x' || substr(md5('mix:' || coalesce(source, chr(0) || 'null')), 1, 8))::bigint / 4294967296.0::double as start from z),
r as (select d.doc_id, d.size, t.*, row_number() over (partition by d.source order by d.size, d.slice, d.doc_id nulls first) - 1 as k
      from d join t on d.source is not distinct from t.source),
c as (select doc_id, size, source_size, target,
        least(floor(start + (k + 1) * (case when source_size > 0 then target / source_size else 0 end))
            - floor(start + k * (case when source_size > 0 then target / source_size else 0 end)), 3)::bigint as copies from r)
select doc_id, size, source_size, target, copies * size as taken, copies from c
"""
