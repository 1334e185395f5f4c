"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents are cut into blocks of equal size, and the mix is a row of slots of one block each. In an ideal mix
all sources that have blocks left flow at once, each at the pace of its weight: source s with weight k has given min(b, k * v) of
its b blocks at virtual time v, and slot t(v) is the sum of that over all sources. Block i (from 0) of s may start at
floor(t(i / k)) and must be done by ceil(t((i + 1) / k)). Every slot takes the released block of earliest deadline (ties:
the smaller source), which keeps every window, so at any slot each source is less than one block away from the ideal mix.
Sources that run out leave their share to the others at once. Nothing is left out and nothing comes twice.

The slots are cut into rounds that are scheduled apart. By the end T of a round all blocks that are due are done, and of the
blocks under way (released, not due) those that earliest deadline first reaches. As no slot is idle, U(a) = (blocks released
before slot a) - a of them are waiting at any slot a. So of the blocks under way at T that were released before a at most U(a)
are left at T, for each a up to T; the earliest deadlines are done as soon as such a bound makes it necessary, and no others.
That is what earliest deadline first does, found for each T from the windows alone. A block's round follows from the ends of rounds at
which it is left; what is done at one end is done at all later ones, and every round gets as many blocks as it has slots (a round that
doesn't raises). Rounds much shorter than the longest window are cut out of longer ones, found in the same way.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Documents of a source that are numbered together, about.
NUMBERED = 4096
#: Weights are whole numbers of about this sum: over 10^11 slots that moves no source by more than 10^-4 blocks.
WHOLE = 10**16
#: Groups of times at which sources run out; blocks look up their own among those of a group.
RUN_OUTS = 256
#: Rounds that a window may reach over; longer ones are found by longer rounds first.
REACH = 64
#: Blocks whose windows are worked out together.
TOGETHER = 8192


def whole_weights(raw: list[float | int]) -> list[int]:
    """Whole-numbered weights: as they are, if they are whole and sum up to no more than WHOLE."""
    if all(isinstance(w, int) for w in raw) and sum(raw) <= WHOLE:
        return list(raw)
    parts = [Fraction(w) for w in raw]
    total = sum(parts)
    return [max(1, round(w * WHOLE / total)) for w in parts]


def run_outs(blocks: list[int], shares: list[int]) -> list[tuple[int, int, int, int]]:
    """(b, k, done, pace) by time: from virtual time b / k on, `done` blocks are those of sources that ran out, and the others flow at `pace`."""
    # two such times differ by 1 / WHOLE^2 at least, so these whole numbers order them
    order = sorted((b << 128) // k for b, k in zip(blocks, shares, strict=True))
    ends: dict[int, list[int]] = {}
    for s, (b, k) in enumerate(zip(blocks, shares, strict=True)):
        ends.setdefault((b << 128) // k, []).append(s)
    done, pace = 0, sum(shares)
    out = [(0, 1, 0, pace)]
    for at in dict.fromkeys(order):
        done += sum(blocks[s] for s in ends[at])
        pace -= sum(shares[s] for s in ends[at])
        out.append((blocks[ends[at][0]], shares[ends[at][0]], done, pace))
    return out


def _product(a: str, b: str) -> str:
    return f"cast({a} as decimal(19,0)) * cast({b} as decimal(19,0))"


def windows(spark: SparkSession, groups: list[tuple[list[int], list[int], list[float]]]) -> DataFrame:
    """number, block, release, deadline, start, stop (slots of the block's group) of all blocks. Groups (numbers of sources, blocks, weights) follow one another."""
    sources, times, start = [], [], 0
    for g, (numbers, blocks, raw) in enumerate(groups):
        shares = whole_weights(raw)
        table = run_outs(blocks, shares)
        size = -(-len(table) // RUN_OUTS)
        place = {(b << 128) // k: j for j, (b, k, _, _) in enumerate(table)}
        stop = start + sum(blocks)
        for number, b, k in zip(numbers, blocks, shares, strict=True):
            sources.append((g, number, k, b, (place[(b << 128) // k] - 1) // size, start, stop))
        for q in range(0, len(table) - 1, size):
            last = table[min(q + size, len(table) - 1)]
            times.append((g, q // size, [(b, k, done, pace) for b, k, done, pace in table[q : q + size]], last[0], last[1]))
        start = stop
    known = spark.createDataFrame(sources, "g int, number int, k long, b long, own int, start long, stop long")
    known = known.withColumn("q", F.explode(F.expr("sequence(0, own)")))
    table = spark.createDataFrame(times, "g int, q int, times array<struct<b:long,k:long,done:long,pace:long>>, end_b long, end_k long")
    # edges i (from 1) between the group's first time and its end, the end included
    edges = known.join(table, ["g", "q"]).withColumn("low", F.expr(f"({_product('k', 'times[0].b')}) div times[0].k + 1")).withColumn("high", F.expr(f"least(b, ({_product('k', 'end_b')}) div end_k)"))
    edges = edges.where("low <= high").withColumn("c", F.explode(F.expr(f"sequence(low, high, {TOGETHER})")))
    edges = edges.repartition(max(1, start // (32 * TOGETHER)), "number", "c").withColumn("i", F.explode(F.expr(f"sequence(c, least(high, c + {TOGETHER - 1}))")))
    edges = edges.withColumn("at", F.expr(f"element_at(filter(times, x -> {_product('x.b', 'k')} < {_product('i', 'x.k')}), -1)"))
    edges = edges.withColumn("flow", F.expr(_product("i", "at.pace")))
    early, late = "start + at.done + flow div k", "start + at.done + (flow + k - 1) div k"
    both = F.array(
        F.struct((F.col("i") - 1).alias("block"), F.lit(None).cast("long").alias("release"), F.expr(late).alias("deadline")),
        F.struct(F.col("i").alias("block"), F.expr(early).alias("release"), F.lit(None).cast("long").alias("deadline")),
    )
    rows = edges.select("number", "start", "stop", "b", F.explode(both).alias("e")).where("e.block < b")
    return rows.groupBy("number", F.col("e.block").alias("block")).agg(F.coalesce(F.max("e.release"), F.max("start")).alias("release"), F.max("e.deadline").alias("deadline"), F.max("start").alias("start"), F.max("stop").alias("stop"))


def rounds(blocks: DataFrame, length: int, reach: int) -> DataFrame:
    """Blocks (see windows()) with start and stop of their rounds of `length` slots, as earliest deadline first does them.

    Windows reach over no more than `reach` rounds. start and stop of blocks are slots between which just they are done.
    """
    at = lambda slot: F.expr(f"({slot} - start) div {length}")
    rows = blocks.withColumn("begin", F.greatest("release", "start")).withColumn("due", F.least("deadline", "stop"))
    rows = rows.withColumn("p", at("begin")).withColumn("last", at("due - 1"))
    # U(a): released blocks that wait at slot a
    per_round = blocks.groupBy("start", "stop").agg(F.count("*").alias("n")).select("start", F.explode(F.expr(f"sequence(0L, (stop - start - 1) div {length})")).alias("p"))
    counts = rows.groupBy("start", "p").agg(F.count("*").alias("n"))
    per_round = per_round.join(counts, ["start", "p"], "left").fillna(0, ["n"]).withColumn("far", F.expr(f"p div {NUMBERED}"))
    far = per_round.groupBy("start", "far").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("start").orderBy("far")) - F.col("n")).select("start", "far", "before")
    sums = per_round.join(far, ["start", "far"]).withColumn("released", F.col("before") + F.sum("n").over(Window.partitionBy("start", "far").orderBy("p")))
    # each step is stored: the next one reads it several times, and its plan would hold that of the step as often
    sums = stored(sums.select("start", "p", (F.col("released") - F.col("n")).alias("before"), (F.col("released") - (F.col("p") + 1) * length).alias("at_end")), "sums")
    own = Window.partitionBy("start", "p")
    waiting = rows.join(sums, ["start", "p"]).withColumn("earlier", F.count("*").over(own.orderBy("begin").rangeBetween(Window.unboundedPreceding, -1)))
    waiting = waiting.withColumn("u", F.col("before") + F.col("earlier") - F.col("begin") + F.col("start"))
    # the least U between a block's release and the end of its round, and that of whole rounds
    waiting = waiting.withColumn("least", F.least("at_end", F.min("u").over(own.orderBy(F.desc("begin")).rangeBetween(Window.unboundedPreceding, -1))))
    waiting = stored(waiting.select("number", "block", "deadline", "start", "begin", "p", "last", "u", "least"), "waiting")
    whole = waiting.groupBy("start", "p").agg(F.min("u").alias("u"))
    whole = sums.join(whole, ["start", "p"], "left").select("start", F.explode(F.expr(f"sequence(p + 1, p + {reach})")).alias("e"), F.struct("p", F.least("u", "at_end").alias("u")).alias("m"))
    whole = whole.groupBy("start", "e").agg(F.collect_list("m").alias("mins"))
    open_at = waiting.where("last > p").select("start", F.explode(F.expr("sequence(p + 1, last)")).alias("e"), F.struct("begin", "deadline", "number", "block", "p", "least").alias("j"))
    open_at = open_at.groupBy("start", "e").agg(F.array_sort(F.collect_list("j")).alias("jobs")).join(whole, ["start", "e"])
    open_at = open_at.withColumn("caps", F.expr("transform(jobs, j -> least(j.least, array_min(transform(filter(mins, m -> m.p > j.p), m -> m.u))))"))
    open_at = open_at.withColumn("steps", F.expr("filter(transform(caps, (c, i) -> struct(i + 1 as i, int(c) as c, get(caps, i + 1) as next)), x -> x.i > x.c and (x.next is null or x.next > x.c))"))
    picked = "transform({}, j -> struct(j.deadline, j.number, j.block))"
    left = F.expr(
        f"""
        aggregate(
          steps,
          struct(cast(array() as array<struct<deadline:bigint,number:int,block:bigint>>) as left, 0 as seen),
          (acc, x) -> struct(
            transform(
              array(array_sort(concat(acc.left, {picked.format('slice(jobs, acc.seen + 1, x.i - acc.seen)')}))),
              h -> if(size(h) <= x.c, h, if(x.c = 0, slice(h, 1, 0), slice(h, -x.c, x.c))))[0] as left,
            x.i as seen),
          acc -> concat(acc.left, {picked.format('slice(jobs, acc.seen + 1, size(jobs))')}))
        """
    )
    left = open_at.select(F.explode(left).alias("j")).groupBy("j.number", "j.block").agg(F.count("*").alias("ends"))
    out = rows.join(left, ["number", "block"], "left").withColumn("p", F.col("p") + F.coalesce("ends", F.lit(0)))
    begin = F.expr(f"start + p * {length}")
    out = stored(out.select("number", "block", "release", "deadline", begin.alias("start"), F.least("stop", begin + length).alias("stop")), "rounds")
    discard(sums, waiting)
    return out


def timetable(spark: SparkSession, groups: list[tuple[list[int], list[int], list[float]]], slots: int) -> DataFrame:
    """number (of a source), block (from 0), round, slot, release, deadline of all blocks of the groups (see windows())."""
    blocks = stored(windows(spark, groups), "blocks")
    # no window is longer than this: the pace is highest before any source has run out
    longest = max((min(sum(b), sum(k) // min(k) + 2) for _, b, raw in groups for k in [whole_weights(raw)]), default=1)
    lengths = [slots]
    while lengths[-1] * REACH < longest:
        lengths.append(lengths[-1] * REACH)
    for length in reversed(lengths):
        before, blocks = blocks, rounds(blocks, length, -(-longest // length) + 1)
        discard(before)
        longest = length
    each = blocks.groupBy("start", "stop").agg(F.collect_list(F.struct("deadline", "number", "block", "release")).alias("jobs"))
    picked = F.expr(
        """
        aggregate(
          sequence(start, stop - 1),
          struct(if(size(jobs) = stop - start, jobs, raise_error('a round has as many blocks as slots')) as left, array() as out),
          (acc, t) -> transform(
            array(coalesce(array_min(filter(acc.left, j -> j.release <= t)), raise_error('a slot has a released block'))),
            c -> struct(filter(acc.left, j -> j.number <> c.number or j.block <> c.block) as left, concat(acc.out, array(struct(t as slot, c as job))) as out))[0],
          acc -> acc.out)
        """.replace("array() as out", "cast(array() as array<struct<slot:bigint,job:struct<deadline:bigint,number:int,block:bigint,release:bigint>>>) as out")
    )
    return each.select(F.explode(picked).alias("c")).select("c.job.number", "c.job.block", F.expr(f"c.slot div {slots}").alias("round"), "c.slot", "c.job.release", "c.job.deadline")


def mix_documents(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_docs: int = 16,
    slots: int = 256,
    temperature: float = 0.5,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Give every document its place in the mix.

    Returns all columns of docs in the struct `row`, with block (number in its source, from 0), round (slots // `slots`), slot
    (place of the block in the whole mix, from 0), release and deadline (slots of the whole mix), and place (of the document
    in its block, from 0).

    Target weights: `weights` by source, relative to one another; without them a source counts by its number of documents to
    the power `temperature`. They are taken as given, however small (see WHOLE). Sources that `weights` doesn't name, or gives 0, come
    when all others have run out, by their sizes. One row of each source passes the driver, which sorts them.

    A null source is a source of its own (in `weights`: None). Documents of a source are dealt into blocks by a hash of their id,
    then by id; ties and repeated rows follow one another in any order, a null id counts as 0. An empty table gives an
    empty result. Columns named like those above don't clash: they stay inside `row`. Rows are ranked as they are: select what
    is needed before (see in_mix_order).
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("null"))
    order = F.coalesce(docs[id_col].cast("string"), F.lit("0"))
    sizes = {r["key"]: r["n"] for r in docs.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).collect()}
    hashed = F.xxhash64(order)
    salts = max(1, sum(sizes.values()) // NUMBERED)
    salt = F.pmod(hashed, F.lit(salts)).cast("int")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), key.alias("key"), salt.alias("salt"), hashed.alias("hash"))

    names = sorted(sizes)
    given = {s: sizes[s] ** temperature for s in names} if weights is None else {("null" if s is None else f"={s}"): w for s, w in weights.items()}
    if any(not 0 <= w < float("inf") for w in given.values()):
        raise ValueError("weights must be finite and not negative")
    number = {s: n for n, s in enumerate(names)}
    groups = [([s for s in names if given.get(s, 0) > 0], given), ([s for s in names if not given.get(s, 0) > 0], sizes)]
    groups = [([number[s] for s in group], [-(-sizes[s] // block_docs) for s in group], [raw[s] for s in group]) for group, raw in groups if group]

    counts = docs.select(key.alias("key"), salt.alias("salt")).groupBy("key", "salt").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("salt")) - F.col("n")).select("key", "salt", "before")
    within = F.row_number().over(Window.partitionBy("key", "salt").orderBy("hash", F.col("row")[id_col])) - 1
    numbers = spark.createDataFrame(list(number.items()), "key string, number int")
    ranked = rows.withColumn("rank", within).join(offsets, ["key", "salt"]).join(numbers, "key").select("row", "number", (F.col("rank") + F.col("before")).alias("rank"))
    placed = ranked.withColumn("block", F.expr(f"rank div {block_docs}")).withColumn("place", F.expr(f"rank % {block_docs}").cast("long"))
    return placed.join(timetable(spark, groups, slots), ["number", "block"]).select("row", "block", "round", "slot", "release", "deadline", "place")


def in_mix_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, all their columns, in the order of the mix: partitions follow one another, and so do rows in them.

    Only ids and hashes of rows are ranked; the rows meet their slots by both. Repeated rows (all columns alike) stand together
    at the first of their places, other ties of id follow one another in any order. Null ids and sources, clashing names and empty
    tables as in mix_documents().
    """
    number = F.coalesce(docs[id_col].cast("string"), F.lit("0"))
    tag = F.xxhash64(*(F.coalesce(docs[c].cast("string"), F.lit("null")) for c in docs.columns))
    thin = docs.select(number.alias("id"), tag.alias("tag"), docs[source_col].alias("source"))
    placed = mix_documents(thin, id_col="id", source_col="source", **options)
    first = stored(placed.groupBy(F.col("row.id").alias("id"), F.col("row.tag").alias("tag")).agg(F.min(F.struct("slot", "place")).alias("at")), "places")
    whole = docs.select(number.alias("id"), tag.alias("tag"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return whole.join(first, ["id", "tag"]).orderBy("at").select("row.*")
