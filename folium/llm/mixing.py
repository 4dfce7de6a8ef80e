"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

DataFrame operations only. The mix has as many words as the table. It is cut into blocks of
equal size; the blocks are allocated to the sources by highest quotients target / (2 k + 1),
for each shard of the mix (the method is house monotone, so that a shard's quota is what
the sources gain when the mix grows by that shard). A source's documents lie in a seeded
order; its stream starts at a seeded block and goes round, each round taking every document
once, and the quotas are taken from that stream.

Defined cases: a null text or one without words has size 0 and takes 0; the null source is a
source of its own and the last in order; equal rows are rows of their own; an empty table
gives an empty result; columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD

WEIGHTS = (5, 2, 1)
BLOCK_WORDS, SHARDS, MAX_REPEAT, SEED = 16, 4, 3, "folium"


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Each row's words, and its place in its source's seeded order."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("place"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, rank, weight, total, target, of a table with source and size.

    Water filling in closed form: sources in order of cap / weight; from the first whose
    share of what is left stays under its cap, all others have the same share by weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source: metadata, not data
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    by_ratio = Window.orderBy("ratio", "rank")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = (
        per.withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("share", F.col("left") / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("share"), F.struct("ratio", "rank", "share"))).over(everything)["share"])
    )
    target = F.when(F.col("total") == 0, 0.0).when(F.col("ratio") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "rank", "weight", "total", target.cast("double").alias("target"))


def quotas(goals: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """source, shard, seats: the blocks of each source in the first ``shard`` shards of the mix.

    The seats by highest quotients are those of a divisor; rounding target / block is right
    up to a few seats, which the next highest (or lowest) quotients settle exactly."""
    blocks = F.round(F.col("total") / block_words).cast("long")
    each = (
        goals.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("house", F.floor(blocks * F.col("shard") / shards).cast("long"))
        .withColumn("first", F.when(F.col("total") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("total") * F.col("house") + 0.5)).cast("long"))
        .withColumn("off", F.col("house") - F.sum("first").over(Window.partitionBy("shard")))
    )
    tries = each.filter("off <> 0").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("off"))))
    up = F.col("off") > 0
    quotient = F.when(up, -F.col("target") / (2 * (F.col("first") + F.col("j")) - 1)).when(F.col("first") >= F.col("j"), F.col("target") / (2 * (F.col("first") - F.col("j")) + 1))
    ranked = tries.withColumn("q", quotient).filter("q is not null")
    # highest first where seats are to be added, lowest first where they are to be taken away; ties: lower rank gains, higher rank loses
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("shard").orderBy("q", F.when(up, F.col("rank")).otherwise(-F.col("rank")), "j")))
    change = ranked.filter(F.col("n") <= F.abs("off")).groupBy("rank", "shard").agg(F.sum(F.signum("off")).cast("long").alias("change"))
    return each.join(change, ["rank", "shard"], "left").select("rank", "source", "source_size", "target", "shard", (F.col("first") + F.coalesce("change", F.lit(0))).alias("seats"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and taken_by_shard of every row.

    A document's place in its source is a prefix sum in two levels (65,536 ranges of the
    seeded hash, then rows of one range), so that no task holds a hot source."""
    rows = sized(docs, seed).withColumn("range", F.substring("place", 1, 4))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("size"))
    goals = targets(ranges, weights, max_repeat)
    seats = quotas(goals, block_words, shards).groupBy("rank", "source", "source_size", "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "seats"))), lambda x: x["seats"]).alias("seats"))
    count = F.ceil(F.col("source_size") / block_words).cast("long")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long")
    seats = (
        seats.withColumn("blocks", count)
        .withColumn("seats", F.transform("seats", lambda x: F.least(x, F.lit(max_repeat) * F.col("blocks"))))
        .withColumn("start", F.when(F.col("blocks") == 0, F.lit(0)).otherwise(start % F.greatest("blocks", F.lit(1))))
    )
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "range", F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("s", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = rows.alias("r").join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.range") == F.col("o.range"))).select("r.doc_id", "r.source", "r.size", (F.col("s") + F.col("offset")).alias("s"))
    full = placed.alias("r").join(seats.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source"))).select("r.*", "source_size", "target", "seats", "blocks", "start")

    def overlap(low, high):
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("s") + F.col("size"), high) - F.greatest(F.col("s"), low))

    def words(n):
        """Words of the document among its source's first n stream blocks."""
        rounds, rest = F.floor(n / F.greatest("blocks", F.lit(1))).cast("long"), n % F.greatest("blocks", F.lit(1))
        end = F.col("start") + rest
        straight = overlap(F.col("start") * block_words, F.least(end, F.col("blocks")) * block_words)
        round_again = overlap(F.lit(0).cast("long"), F.greatest(end - F.col("blocks"), F.lit(0)) * block_words)
        return rounds * F.col("size") + straight + round_again

    by_shard = F.transform("seats", lambda n, i: words(n) - F.when(i == 0, F.lit(0).cast("long")).otherwise(words(F.get(F.col("seats"), i - 1))))
    return full.select("doc_id", "source", "size", "source_size", "target", words(F.element_at("seats", -1)).cast("long").alias("taken"), by_shard.alias("taken_by_shard"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each as often as the mix takes it, rounded to whole documents.
    Documents that the mix doesn't reach, and those without words, are not in it."""
    times = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    taken = mix_sources(docs, **options).select("doc_id", times.alias("_times")).filter("_times > 0").groupBy("doc_id").agg(F.max("_times").alias("_times"))
    return docs.join(taken, "doc_id").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)


def mixing_sql(block_words: int = BLOCK_WORDS, shards: int = SHARDS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> str:
    """The whole mix in DuckDB. Its capping goes round by round, its seats by listing quotients near the divisor's."""
    return rf"""
with recursive r as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size,
    md5('{seed}:' || coalesce(doc_id::varchar, '')) as place from documents),
p as (select source, sum(size)::double as ss from r group by source),
w as (select *, row_number() over (order by source nulls last) as rank from p),
w2 as (select *, [{', '.join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1]::double as weight, sum(ss) over () as total from w),
fill as (
  select 0 as step, rank, weight, ss, total, false as capped, total / sum(weight) over () as lam from w2
  union all
  select step + 1, rank, weight, ss, total, now,
    (total - sum(case when now then {max_repeat} * ss else 0 end) over ()) / nullif(sum(case when now then 0 else weight end) over (), 0)
  from (select *, capped or lam * weight > {max_repeat} * ss as now from fill where step < 64)),
t as (select w2.*, case when total = 0 then 0.0 when f.capped then {max_repeat} * w2.ss else f.lam * f.weight end as target
  from w2 join fill f using (rank, weight, ss, total) where f.step = 64),
h as (select *, round(total / {block_words})::bigint as house, greatest(0, floor(target / nullif(total, 0) * round(total / {block_words}) + 0.5))::bigint as k0 from t),
o as (select *, house - sum(k0) over () as off from h),
q as (select rank, off, case when off > 0 then -target / (2 * (k0 + j) - 1) else target / (2 * (k0 - j) + 1) end as q, j
  from o, unnest(generate_series(1, abs(off)::bigint)) as g(j) where off > 0 or k0 >= j),
c as (select rank, sum(sign(off)) as change from (select *, row_number() over (order by q, case when off > 0 then rank else -rank end, j) as n from q) where n <= abs(off) group by rank),
s as (select o.source, o.ss::bigint as source_size, target, ceil(ss / {block_words})::bigint as blocks,
    least(k0 + coalesce(change, 0), {max_repeat} * ceil(ss / {block_words}))::bigint as n,
    ('0x' || substr(md5('{seed}/' || coalesce(o.source, '')), 1, 8))::bigint as seed from o left join c using (rank)),
a as (select *, case when blocks = 0 then 0 else seed % blocks end as b, n // greatest(blocks, 1) as rounds, n % greatest(blocks, 1) as m from s),
d as (select r.doc_id, size, source_size, target, blocks, b, rounds, m,
    (sum(size) over (partition by r.source order by place, doc_id, size rows between unbounded preceding and current row) - size)::bigint as lo
  from r join a on r.source is not distinct from a.source)
select doc_id, size, source_size, target, (rounds * size
  + greatest(0, least(lo + size, least(b + m, blocks) * {block_words}) - greatest(lo, b * {block_words}))
  + greatest(0, least(lo + size, greatest(b + m - blocks, 0) * {block_words}) - lo))::bigint as taken
from d"""
