"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. *Permute locally*: every scan partition sorts its rows by a hash of their
   row number (no exchange) and is written with the rank of every row.
2. *Draw the matrix*: how many rows each partition sends to each shard. Of a
   uniform permutation these counts follow a multivariate hypergeometric law:
   row sums are the partitions' row counts, column sums the shards' sizes. They
   are drawn exactly, down a tree over the partitions with ``FAN`` children a
   node: a node's shard counts are dealt to its children one draw after the
   other, so no task sees more than FAN x shards numbers and the matrix is
   never gathered. A draw is a rejection step for log-concave laws (Devroye
   1987): its cost does not depend on the counts.
3. *Exchange*: ranks are cut at a partition's running counts; each row goes to
   its shard and, there, to the chunk that its second random key falls into.
4. *Permute again*: chunks are sorted by that key; chunk sizes, counted on the
   narrow columns, place every chunk, which makes slots gapless.

DataFrame functions only; no Python runs on the executors, nothing but the
numbers of rows and partitions reaches the driver. All randomness is a hash of
the seed and of written numbers, so a task that runs again decides alike. The
counts are exact at every size; the law of a draw is exact up to the rounding
of log-factorials in double precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from rentlens.session import materialize

#: Children of a node of the matrix tree.
FAN = 16
#: Candidates of a draw: the first FEW, and the rest if none of them is taken. Each is taken with probability 1/5 at
#: least, so that none of all TRIES is has probability 0.8^TRIES (4e-20) at most; the draw is then the mode.
FEW, TRIES = 16, 200
#: Rows that a chunk of a shard holds on average: the unit of the second exchange.
CHUNK_ROWS = 8192
#: monotonically_increasing_id() is the partition's number shifted by so many bits, plus the row's number in it.
ROW_BITS = 33


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that the keys determine."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)


def log_factorial(n: Column) -> Column:
    """ln n!: exact below 16, by Stirling's series (error under 1e-11) from there."""
    x = F.greatest(n.cast("double"), F.lit(16.0))
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(15)).cast("int")).cast("double"))).otherwise(series)


def hypergeometric(good: Column, bad: Column, draws: Column, *keys: Column) -> Column:
    """How many of ``draws`` balls, taken without replacement from ``good`` + ``bad``, are good; random by ``keys``."""
    least, most = F.greatest(F.lit(0).cast("long"), draws - bad), F.least(good, draws)

    def weight(k: Column, s: Column) -> Column:
        """-ln of the probability of k, up to a constant."""
        return (log_factorial(k) + log_factorial(s.good - k) + log_factorial(s.draws - k)
                + log_factorial(s.bad - s.draws + k))

    def with_mode(s: Column) -> Column:
        mode = F.floor((s.draws + 1.0) * (s.good + 1.0) / (s.good + s.bad + 2.0))
        return _let(s.withField("mode", F.least(F.greatest(mode, s.least), s.most)), with_peak)

    def with_peak(s: Column) -> Column:
        top = weight(s.mode, s)
        total = (log_factorial(s.good) + log_factorial(s.bad) + log_factorial(s.draws)
                 + log_factorial(s.good + s.bad - s.draws) - log_factorial(s.good + s.bad))
        return _let(s.withField("top", top).withField("peak", F.exp(total - top)), draw)

    def draw(s: Column) -> Column:
        def attempt(taken: Column, i: Column) -> Column:
            w = 1 + s.peak / 2
            u, v, accept, side = (uniform(*keys, i, F.lit(j)) for j in range(4))
            y = F.when(u <= w / (1 + w), v * w / s.peak).otherwise((w - F.log(v)) / s.peak)

            def judge(c: Column) -> Column:
                inside = (c.k >= s.least) & (c.k <= s.most)
                bound = F.least(F.lit(1.0), F.exp(w - s.peak * c.y))
                return F.when(inside & (accept * bound <= F.exp(s.top - weight(F.least(F.greatest(c.k, s.least), s.most), s))), c.k)

            step = F.round(y).cast("long")
            fresh = _let(F.struct(y.alias("y"), (s.mode + F.when(side < 0.5, step).otherwise(-step)).alias("k")), judge)
            return F.when(taken.isNotNull(), taken).otherwise(fresh)

        none = F.lit(None).cast("long")
        return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(FEW)), none, attempt),
                          F.aggregate(F.sequence(F.lit(FEW + 1), F.lit(TRIES)), none, attempt), s.mode)

    state = F.struct(good.alias("good"), bad.alias("bad"), draws.alias("draws"), least.alias("least"), most.alias("most"))
    return F.when(least >= most, least).otherwise(_let(state, with_mode))


def _deal(caps: Column, children: Column, *keys: Column) -> Column:
    """The shard counts ``caps`` of a node dealt to its children (array of (q, n), the n adding up to the counts):
    array of (q, caps)."""
    def child(state: Column, kid: Column) -> Column:
        def shard(s: Column, cap: Column) -> Column:
            k = hypergeometric(cap, s.pool - cap, s.need, *keys, kid.q, F.size(s.got))
            return _let(k, lambda x: F.struct((s.pool - cap).alias("pool"), (s.need - x).alias("need"),
                                              F.concat(s.got, F.array(x)).alias("got")))

        pool = F.aggregate(state.left, F.lit(0).cast("long"), lambda a, x: a + x)
        first = F.struct(pool.alias("pool"), kid.n.alias("need"), F.array().cast("array<bigint>").alias("got"))
        got = F.aggregate(state.left, first, shard, lambda s: s.got)
        return _let(got, lambda g: F.struct(F.zip_with(state.left, g, lambda a, b: a - b).alias("left"),
                                            F.concat(state.out, F.array(F.struct(kid.q.alias("q"), g.alias("caps")))).alias("out")))

    begin = F.struct(caps.alias("left"), F.array().cast("array<struct<q:bigint,caps:array<bigint>>>").alias("out"))
    return F.aggregate(children, begin, child, lambda s: s.out)


def communication_matrix(counts: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """(p, caps): rows that partition p sends to each shard, drawn as a uniform permutation would.

    ``counts`` has (p, n), n rows of partition p, one row per p; they add up to the sum of ``sizes``.
    """
    last = counts.agg(F.max("p")).first()[0]
    shards = F.array(*[F.lit(int(x)).cast("long") for x in sizes])
    nodes = counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("q"), shards.alias("caps"))
    if last is None:
        return nodes.toDF("p", "caps").where("false")
    depth = 0
    while FAN ** depth <= last:
        depth += 1
    for level in range(1, max(depth, 1) + 1):
        width = FAN ** (max(depth, 1) - level)
        kids = (counts.groupBy(F.floor(F.col("p") / width).alias("kid")).agg(F.sum("n").alias("n"))
                .groupBy(F.floor(F.col("kid") / FAN).alias("parent"))
                .agg(F.sort_array(F.collect_list(F.struct(F.col("kid").alias("q"), "n"))).alias("kids")))  # FAN at most
        nodes = nodes.join(kids, F.col("q") == F.col("parent")).select(
            F.inline(_deal(F.col("caps"), F.col("kids"), F.lit(seed), F.lit(level))))
        if level % 2 == 0:
            nodes = materialize(nodes)  # the draws of a level run once, and the plan stays short
    return nodes.toDF("p", "caps")


def shard(docs: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with law, shard, slot and grown_shard.

    Every row, whatever it holds, goes to exactly one shard: null ids and texts, repeated rows and equal texts (a
    group of copies is spread like any other rows) are rows of their own. Shard sizes differ by one row at most (law
    ``rows``; the first shards are the larger ones); slots run from 0 without gaps within a shard, in random order.
    ``grown_shard`` is null: another number of shards is another shuffle. Columns of ``docs`` named like the new ones
    are replaced. An empty table gives an empty result.
    """
    new = ["law", "shard", "slot", "grown_shard"]
    docs = docs.drop(*new)
    # 1. permute locally: sorted within the scan partitions, no exchange
    local = (docs.withColumn("__key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
             .sortWithinPartitions("__key").drop("__key").withColumn("__at", F.monotonically_increasing_id()))
    local = materialize(local)
    place = local.select("__at", F.shiftright("__at", ROW_BITS).alias("__p"),
                         F.col("__at").bitwiseAND((1 << ROW_BITS) - 1).alias("__rank"))
    # 2. the matrix
    counts = materialize(place.groupBy(F.col("__p").alias("p")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(counts, sizes, seed)
    edges = F.aggregate("caps", F.array().cast("array<bigint>"), lambda a, x: F.concat(
        a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + x)))
    matrix = materialize(matrix.select(F.col("p").alias("__part"), edges.alias("__edges")))
    # 3. each row's shard and chunk
    chunks = -(-total // (n_shards * CHUNK_ROWS)) or 1
    key = F.xxhash64(F.lit(seed), F.lit("second"), "__at")

    def addressed(rows: DataFrame) -> DataFrame:
        """Rows with their shard, second key and the chunk of the shard that the key falls into."""
        rows = (rows.withColumn("__p", F.shiftright("__at", ROW_BITS))
                .withColumn("__rank", F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)).withColumn("__second", key))
        rows = rows.join(matrix, F.col("__p") == F.col("__part"))
        to = F.size(F.filter("__edges", lambda e: e <= F.col("__rank")))
        chunk = F.floor(F.shiftrightunsigned("__second", 11) * F.lit(2.0 ** -53) * chunks)
        return rows.withColumn("shard", to.cast("int")).withColumn("__chunk", chunk).drop("__p", "__rank", "__part", "__edges")

    sized = addressed(local.select("__at")).groupBy("shard", "__chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = sized.select(F.col("shard").alias("__s"), F.col("__chunk").alias("__c"), F.coalesce(before, F.lit(0)).alias("__start"))
    # 4. permute again, chunk by chunk
    within = Window.partitionBy("shard", "__chunk").orderBy("__second", "__at")
    rows = addressed(local).withColumn("__nth", F.row_number().over(within) - 1)
    rows = rows.join(starts, (F.col("shard") == F.col("__s")) & (F.col("__chunk") == F.col("__c")))
    return rows.select(*docs.columns, F.lit("rows").alias("law"), "shard", (F.col("__nth") + F.col("__start")).alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int, seed: int = 0) -> None:
    """The shuffled rows as Parquet folders ``shard=<number>``, each file sorted by slot."""
    shard(docs, n_shards, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32 (a null text counts as empty) and
    the place of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                          "law", "shard", "slot", "grown_shard")
