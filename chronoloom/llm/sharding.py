"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters rows uniformly into buckets of about BUCKET_BYTES, by a seeded hash of the whole row;
rows that are equal in all columns are told apart by a number, so copies and hot keys spread too. Pass two
shuffles each bucket: the same hash deals its rows into hands of about HAND rows, and every hand, sorted by
the hash, is put in order by a Fisher-Yates shuffle whose draws are hashes of seed, bucket, hand and step.
A bucket is the hands one after another, so it is a uniform permutation held in arrays of some HAND rows,
and only the seed and the rows decide it: neither the input's files nor the number of tasks, so that a task
that runs again deals alike.

Law "rows": a row's place is its bucket's first place plus its place there. The places are cut into n ranges
whose lengths differ by one at most, so that a bucket, written by one task, falls into one shard or two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm._shared import SENT_IDS, cut

BUCKET_BYTES = 64 << 20
HAND = 64
TASKS = 20_000  # tasks that the buckets are dealt to, at most
GROUP = 4096  # buckets whose running sum is one task's


def _hashable(field: T.StructField, column: Column) -> Column:
    """A column as xxhash64 takes it: maps have no hash of their own."""
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column


def _octets(field: T.StructField, column: Column) -> Column:
    """About how many bytes a value takes."""
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(field.dataType, T.AtomicType):
        return F.lit(8)
    return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 8


def _numbered(df: DataFrame) -> DataFrame:
    """df and _copy: 0, or a number of its own for each of several equal rows. Only those are grouped."""
    columns = df.columns
    names = [_hashable(f, F.col(f.name)) for f in df.schema.fields]
    two = [F.xxhash64(F.lit(i), *names).alias(f"_d{i}") for i in (1, 2)]
    many = cut(df.select(*two).groupBy("_d1", "_d2").count().filter("count > 1").select("_d1", "_d2"))
    n = many.count()
    if n == 0:
        return df.withColumn("_copy", F.lit(0).cast("long"))
    many = F.broadcast(many) if n <= SENT_IDS else many
    each = df.select(*columns, *two)
    single = each.join(many, ["_d1", "_d2"], "left_anti").select(*columns, F.lit(0).cast("long").alias("_copy"))
    # Equal rows are counted, which combines before the shuffle, and dealt out again.
    copies = each.join(many, ["_d1", "_d2"], "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return single.unionByName(copies.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy")))


def _sorted(rows: Column, schema: T.StructType) -> Column:
    """rows by their hashes and numbers; maps can't be compared, so rows with maps are sorted by a rule of their own."""
    if "map<" not in schema.simpleString():
        return F.sort_array(rows)
    by = lambda r: F.struct(r["_deal"], r["_deal2"], r["_copy"])
    return F.array_sort(rows, lambda a, b: F.when(by(a) < by(b), F.lit(-1)).when(by(a) > by(b), F.lit(1)).otherwise(F.lit(0)))


def fisher_yates(n: Column, draw) -> Column:
    """A permutation of 1 to n as an array: from the last place down, each is swapped with one at or before it. draw(i): 64 random bits."""

    def step(acc: Column, i: Column) -> Column:
        j = F.pmod(draw(i), i.cast("long")).cast("int") + 1
        return F.transform(F.array(j), lambda j: F.transform(acc, lambda x, k: F.when(k + 1 == i, F.element_at(acc, j)).when(k + 1 == j, F.element_at(acc, i)).otherwise(x)))[0]

    return F.aggregate(F.when(n > 1, F.sequence(n, F.lit(2), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)")), F.sequence(F.lit(1), n), step)


def shuffled(df: DataFrame, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df in a seeded uniform order: its columns and place (long, 0 to rows - 1).

    Any column may be null; repeated rows stay as many as they are; an empty table gives an empty one; columns
    of any name are kept, but one called place is replaced. Texts of any length are carried whole; a row larger
    than a bucket is one by itself.
    """
    return _placed(df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "place"]), seed, bucket_bytes)[0]


def _placed(df: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """df with place, and the number of rows."""
    names = df.columns
    schema = df.schema
    df = df.toDF(*[f"c{i}" for i in range(len(names))])  # names of the caller's can't clash with those used here
    columns = [F.col(c) for c in df.columns]
    size = sum((_octets(f, F.col(c)) for f, c in zip(schema.fields, df.columns, strict=True)), F.lit(0))
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("size")).first()
    n = max(1, -(-(total.size or 0) // bucket_bytes))
    hands = max(1, -(-total.n // (n * HAND)))
    hashed = [_hashable(f, c) for f, c in zip(schema.fields, columns, strict=True)]
    dealt = _numbered(df).withColumn("_deal", F.xxhash64(F.lit(seed), "_copy", *hashed)).withColumn("_bucket", F.pmod("_deal", F.lit(n)))
    dealt = dealt.withColumn("_hand", F.pmod(F.xxhash64(F.lit(seed), F.lit(1), "_deal"), F.lit(hands)))
    # The first place of each bucket: a running sum in two levels.
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size")).withColumn("_group", F.expr(f"_bucket div {GROUP}"))
    sizes = cut(sizes)
    groups = sizes.groupBy("_group").agg(F.sum("_size").alias("_sum"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # a row for every GROUP buckets
    groups = groups.select("_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.join(groups, "_group").select("_bucket", (F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).alias("_first"))
    first = F.broadcast(first) if n <= SENT_IDS else first
    # Scatter, then shuffle each bucket's hands; rows meet by bucket, which holds for hands and running sums as well.
    hand = (
        dealt.repartition(min(n, TASKS), "_bucket")
        .groupBy("_bucket", "_hand")
        .agg(_sorted(F.collect_list(F.struct("_deal", F.xxhash64(F.lit(2), *hashed).alias("_deal2"), "_copy", F.struct(*columns).alias("row"))), schema).alias("_rows"))
        .withColumn("_n", F.size("_rows"))
    )
    earlier = Window.partitionBy("_bucket").orderBy("_hand").rowsBetween(Window.unboundedPreceding, -1)
    hand = hand.withColumn("_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    order = fisher_yates(F.col("_n"), lambda i: F.xxhash64(F.lit(seed), F.lit(3), F.col("_bucket"), F.col("_hand"), i))
    hand = hand.withColumn("_order", order).join(first, "_bucket")
    hand = hand.select((F.col("_first") + F.col("_at")).alias("_base"), F.transform("_order", lambda k: F.element_at("_rows", k)["row"]).alias("_rows"))
    out = hand.select("_base", F.posexplode("_rows").alias("_pos", "row")).select("row.*", (F.col("_base") + F.col("_pos")).alias("_place"))
    return out.toDF(*names, "place"), total.n


def shard(df: DataFrame, n_shards: int = 24, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's columns, shard (int) and slot (long), under the law "rows"; slots are gapless from 0 in each shard. As for shuffled()."""
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    done, rows = _placed(df.select(*[F.col(f"`{c}`") for c in kept]), seed, bucket_bytes)
    done = done.toDF(*[f"c{i}" for i in range(len(kept))], "place")
    size, longer = divmod(rows, n_shards)  # the first `longer` shards hold one row more
    border = longer * (size + 1)
    far, least = f"place - {border}", max(1, size)
    shard_ = F.expr(f"CASE WHEN place < {border} THEN place div {size + 1} ELSE {longer} + ({far}) div {least} END").cast("int")
    slot = F.expr(f"CASE WHEN place < {border} THEN place % {size + 1} ELSE ({far}) % {least} END").cast("long")
    return done.select(*[F.col(f"c{i}") for i in range(len(kept))], shard_.alias("shard"), slot.alias("slot")).toDF(*kept, "shard", "slot")


def write(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet folders shard=0 and so on. Each task writes the buckets it shuffled, in slot order; nothing is shuffled again."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
