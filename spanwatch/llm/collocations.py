"""Phrase collocations: counts of phrases by marginalising the longest windows, and the most cohesive ones per language.

Every word starts one window of three words, padded where its piece ends. Only these windows are counted. A
phrase of one or two words is a prefix of windows, so ROLLUP over the counted windows sums its occurrences; shorter phrases are
never taken from the texts again.

Most windows are rare, and a row for each would shuffle many times the texts. So a task sends its counted windows in
blocks, one for each bucket of first two words, and as all windows of a bucket meet in one task, those that are too rare to
matter are shortened there: they count as the longest prefix that is frequent enough, padded.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwatch.llm.common import cut, fresh_path, scratch, small_batches

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = ".,;:!?\n\x0b\x0c\r"
_PLAIN = str.maketrans(_UPPER + _ENDS + "\t", _LOWER + "\n" * len(_ENDS) + " ")
_SPREAD = 16  # parts of a pair of hot words


def windows(text: str):
    """The windows of a text, their words joined by blanks: three words, fewer at the end of a piece. A-Z is lower-cased, pieces
    end at ``.,;:!?`` and line ends, words at blanks and tabs."""
    for piece in text.translate(_PLAIN).split("\n"):
        w = [x for x in piece.split(" ") if x]
        if w:
            lead = w[1:]
            yield from map(" ".join, zip(w, lead, w[2:]))
            if lead:
                yield f"{w[-2]} {w[-1]}"
            yield w[-1]


def _buckets(counts: Counter, buckets: int, hot: frozenset[str]) -> dict[int, list[str]]:
    """The windows as lines (with a tab and their number if that is not 1) by bucket. Windows with the same first
    two words share one; where both are hot their third word spreads them over more, which are told by a negative number."""
    out: dict[int, list[str]] = {}
    for window, n in counts.items():
        first = window.find(" ")
        second = window.find(" ", first + 1) if first >= 0 else -1
        pair = window if second < 0 else window[:second]
        b = crc32(pair.encode("utf-8", "surrogatepass")) % buckets
        if first >= 0 and window[:first] in hot and pair[first + 1 :] in hot:
            b = -1 - (b + crc32(window.encode("utf-8", "surrogatepass")) % _SPREAD) % buckets
        line = window if n == 1 else f"{window}\t{n}"
        if b in out:
            out[b].append(line)
        else:
            out[b] = [line]
    return out


def hot_words(docs: DataFrame, text_col: str = "text", share: float = 0.001, fraction: float = 0.01) -> frozenset[str]:
    """Words that make up more than ``share`` of a sample of the texts, at most 1 / share. They decide only how windows are dealt over
    tasks, never what comes out."""
    words = docs.sample(fraction, 7).select(F.explode(F.split(F.regexp_replace(F.lower(F.col(text_col).cast("string")), "[.,;:!?\\n\\x0b\\f\\r\\t]", " "), " +")).alias("w"))
    n = cut(words.groupBy("w").agg(F.count("*").alias("n")), "collocations-sample")
    least = (n.agg(F.sum("n")).first()[0] or 0) * share
    return frozenset(r.w for r in n.where(F.col("n") > least).collect())


def blocks(
    docs: DataFrame, buckets: int, hot: frozenset[str] = frozenset(), text_col: str = "text", lang_col: str = "lang", most: int = 400_000
) -> DataFrame:
    """(lang, bucket, lines): the windows of all texts, counted in a task up to ``most`` distinct ones at a time. Null texts have
    no words, null languages are ``und``."""

    def run(batches):
        held: dict[str, Counter] = {}

        def sent():
            for lang, counts in held.items():
                dealt = _buckets(counts, buckets, hot)
                columns = [pa.array(repeat(lang, len(dealt)), pa.string(), size=len(dealt)), pa.array(list(dealt), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(["\n".join(x) for x in dealt.values()])], ["lang", "bucket", "lines"])
            held.clear()

        for b in small_batches(batches, 64):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    held.setdefault(lang, Counter()).update(windows(text))
            if sum(map(len, held.values())) > most:
                yield from sent()
        yield from sent()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "lang string, bucket int, lines string")


def window_counts(docs: DataFrame, least: int = 1, text_col: str = "text", lang_col: str = "lang", hot: frozenset[str] = frozenset()) -> DataFrame:
    """(lang, w1, w2, w3, n): windows of three words of ``least`` occurrences, and all windows without their third word (null):
    as (w1, w2), where that has ``least``, else as (w1), so the prefixes of ``least`` occurrences and all words have their whole number.

    No key gathers many rows: a bucket's windows were counted before, a hot pair is spread over buckets and never shortened there."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = blocks(docs, max(tasks, 1024), hot, text_col, lang_col).repartition(tasks, "lang", "bucket")
    line = sent.select("lang", "bucket", F.explode(F.split("lines", "\n")).alias("line"))
    told = F.expr("if(locate('\t', line) = 0, 1L, cast(substring_index(line, '\t', -1) as long))")
    key = ["lang", "bucket", "words"]  # words stay joined by blanks until few rows are left
    whole = line.select("lang", "bucket", F.substring_index("line", "\t", 1).alias("words"), told.alias("n")).groupBy(*key).agg(F.sum("n").alias("n"))
    first = lambda k: F.substring_index("words", " ", k)
    often = (F.col("n") >= least) & (F.col("words") != first(2))
    both = F.when(often, F.array(first(2), "words")).otherwise(F.array(first(2)))
    summed = whole.select("lang", "bucket", F.explode(both).alias("words"), "n").groupBy(*key).agg(F.sum("n").alias("n"))
    kept = F.when((F.col("n") >= least) | (F.col("bucket") < 0), F.col("words")).otherwise(first(1))
    out = summed.select("lang", kept.alias("words"), "n").groupBy("lang", "words").agg(F.sum("n").alias("n"))
    w = F.split("words", " ")
    return out.select("lang", *[F.get(w, F.lit(k)).alias(f"w{k + 1}") for k in range(3)], "n")


def prefix_counts(counted: DataFrame) -> DataFrame:
    """(lang, w1, w2, words, f) from :func:`window_counts`: f of phrases of ``words`` words, 2 or 1; with 0 words that of all words of
    a language."""
    summed = counted.where("w3 is null").rollup("lang", "w1", "w2").agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    words = F.when(F.col("g") == 0, 2).when(F.col("g") == 1, 1).when(F.col("g") == 3, 0)
    # a window without a second word is no phrase of two; the total over languages has no use
    return summed.select("lang", "w1", "w2", words.alias("words"), "f").where("words < 2 or w2 is not null")


def _with_count(rows: DataFrame, counts: DataFrame, keys: list[str], name: str, common: int) -> DataFrame:
    """``rows`` with the count f of their phrase as ``name``. ``counts`` has (keys, f) for phrases; those of more than ``common``
    occurrences are broadcast, so that none of them is the key of one task. Their f sum up to all words at most, which bounds their number."""
    hot = F.broadcast(counts.where(F.col("f") > common).withColumnRenamed("f", "hot"))
    told = rows.join(hot, keys, "left")
    rest = told.where("hot is null").drop("hot").join(counts.where(F.col("f") <= common).withColumnRenamed("f", name), keys)
    return cut(told.where("hot is not null").withColumnRenamed("hot", name).unionByName(rest), "collocations-counted")


def collocations(
    docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Per language its ``top`` phrases of two and three words: lang, rank (from 1), phrase, a, l, r, n, score.

    a is the number of occurrences (``least`` and more), l and r those of the two parts of the phrase at the cut that gives the lowest
    score, of equal ones the first; n all words of the language; score floor(10^6 a^2 / (l r)), in decimals. A phrase of two words goes where one
    of three words that holds it has ``share`` percent of its occurrences or more. Order: score, a descending, phrase.

    Occurrences overlap and repeated rows count each. Null texts have no words; a null language is ``und``, as is a
    language of that name. A text is split by one task, in memory of a few times its length; windows that a task has counted are sent
    whenever they are many. An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    result = fresh_path(spark, "collocations")
    with scratch(spark):
        counted = cut(window_counts(docs, least, text_col, lang_col, hot_words(docs, text_col)), "collocations-windows")
        shorter = cut(prefix_counts(counted), "collocations-prefixes")
        # at most 20 000 phrases of a length make up more than 1 / 20 000 of all words each
        common = (shorter.where("words = 0").agg(F.sum("f")).first()[0] or 0) // 20_000
        one = shorter.where("words = 1").select("lang", "w1", "f")
        two = shorter.where("words = 2").select("lang", "w1", "w2", "f")
        first, last = one, one.withColumnRenamed("w1", "w2")
        pairs = two.where(F.col("f") >= least).withColumnRenamed("f", "a")
        triples = counted.where(F.col("w3").isNotNull() & (F.col("n") >= least)).withColumnRenamed("n", "a")
        triples = cut(triples, "collocations-triples")
        held = triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        held = held.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
        pairs = pairs.join(held, ["lang", "w1", "w2"], "left").where(f"longer is null or 100 * longer < {share} * a").drop("longer")
        pairs = cut(pairs, "collocations-pairs")
        pairs = _with_count(_with_count(pairs, first, ["lang", "w1"], "l", common), last, ["lang", "w2"], "r", common)
        pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score"))
        # two cuts: after the first word and after the second
        triples = _with_count(triples, first, ["lang", "w1"], "l1", common)
        triples = _with_count(triples, two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), "f"), ["lang", "w2", "w3"], "r1", common)
        triples = _with_count(triples, two, ["lang", "w1", "w2"], "l2", common)
        triples = _with_count(triples, one.withColumnRenamed("w1", "w3"), ["lang", "w3"], "r2", common)
        cuts = [F.struct(_score(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
        triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(*cuts).alias("c"))
        triples = triples.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
        ranked = pairs.unionByName(triples).withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)"))
        words = shorter.where("words = 0").select("lang", F.col("f").alias("n"))
        out = ranked.where(F.col("rank") <= top).join(words, "lang")  # ``top`` rows of a language at most
        return cut(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations", result)


def _score(l: str, r: str) -> Column:
    """floor(10^6 a^2 / (l r)); l and r are a at least, so it is 10^6 at most, while the products fit 38 digits up to a of 10^16."""
    return F.expr(f"cast(1000000 as decimal(7, 0)) * (cast(a as decimal(16, 0)) * a) div (cast({l} as decimal(18, 0)) * {r})")


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as p, piece from (
    select lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
), listed as (
  select lang, p, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces
), phrases as (
  select lang, k, list_slice(ws, i, i + k - 1) as ph from (
    select lang, ws, unnest(range(1, len(ws) + 1)) as i from listed) cross join (values (1), (2), (3)) as lengths(k) where i + k - 1 <= len(ws)
), f as (select lang, k, ph, count(*) as f from phrases group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
cand as (select lang, k, ph, f as a from f where k > 1 and f >= 10),
kept as (
  select * from cand c where not exists (
    select 1 from (select lang, unnest([ph[1:2], ph[2:3]]) as inner_ph, a from cand where k = 3) t
    where c.k = 2 and t.lang = c.lang and t.inner_ph = c.ph and 100 * t.a >= 50 * c.a)
), cuts as (
  select c.lang, c.ph, c.a, cut, x.f as l, y.f as r, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
  from (select *, unnest(range(1, k)) as cut from kept) c
  join f x on x.lang = c.lang and x.ph = c.ph[1:cut] join f y on y.lang = c.lang and y.ph = c.ph[cut + 1:]
), best as (
  select lang, array_to_string(ph, ' ') as phrase, a, l, r, score, row_number() over (partition by lang, ph order by score, cut) as b from cuts
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best where b = 1)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""
