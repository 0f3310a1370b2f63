"""Writes as plans: what a table becomes, given its rows and the incoming ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StructField, StructType
from pyspark.sql.window import Window


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def insert_ignore(table: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows whose key is new are added, the first of each; known keys stay as they are."""
    first = incoming.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    known = table.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return table.unionByName(first.join(known, _same(keys), "left_anti").select(*table.columns))


def insert_replace(table: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Incoming rows replace those of their key; the last by ``order`` wins."""
    last = incoming.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    new = last.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return table.join(new, _same(keys), "left_anti").unionByName(last.select(*table.columns))


def upsert(table: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Known keys take the incoming ``update`` columns and keep the others; new keys are added."""
    return _merged(table, incoming, keys, {c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in update})


def sticky_upsert(table: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Like ``upsert``, but a null or ``{}`` never replaces a value."""
    return _merged(table, incoming, keys, {c: F.coalesce(F.when(F.col(f"_{c}").cast("string") != "{}", F.col(f"_{c}")), F.col(c)) for c in update})


def _merged(table: DataFrame, incoming: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    right = incoming.select(*[F.col(c).alias(f"_{c}") for c in table.columns], F.lit(True).alias("_there"))
    j = table.withColumn("_here", F.lit(True)).join(right, _same(keys), "full")
    return j.select(*[F.when(F.col("_here").isNull(), F.col(f"_{c}")).otherwise(values.get(c, F.col(c))).alias(c) for c in table.columns])


def bump_seen(table: DataFrame, incoming: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
    """Keys of both with the earliest ``first`` and the latest ``last``."""
    rows = table.select(*keys, first, last).unionByName(incoming.select(*keys, first, last))
    return rows.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last))


def replace_owned(table: DataFrame, owned: DataFrame, owner: str, owners: Sequence) -> DataFrame:
    """All rows of ``owners`` give way to ``owned``; running it again changes nothing."""
    return table.where(~F.coalesce(F.col(owner).isin(*owners), F.lit(False))).unionByName(owned.select(*table.columns))


def rebuild_owned(owned: DataFrame, path: str, owner: str, owners: Sequence[str]) -> DataFrame:
    """The table at ``path``, a folder an owner, with the rows of ``owners`` replaced by those that ``owned`` has of them.

    Folders of other owners aren't touched; those of ``owners`` without rows go. Running it again gives the
    same table. Owners are text, null is one of its own.
    """
    spark, named = owned.sparkSession, [o for o in owners if o is not None]
    mine = F.coalesce(F.col(owner).isin(*named), F.lit(None in owners))
    rows = owned.where(mine)
    rows.write.partitionBy(owner).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    gone = {"__HIVE_DEFAULT_PARTITION__" if o is None else o for o in owners} - {"__HIVE_DEFAULT_PARTITION__" if r[0] is None else r[0] for r in rows.select(owner).distinct().collect()}
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in files.listStatus(root):
        if unquote(f.getPath().getName()).removeprefix(f"{owner}=") in gone and f.isDirectory():
            files.delete(f.getPath(), True)
    return spark.read.schema(owned.schema).parquet(path).select(*owned.columns)


def rewrite_keys(facts: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` with old keys replaced through ``mapping(old, new)``."""
    m = mapping.select("old", "new")
    return facts.join(m, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def reference_counts(references: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, one count a table): how many rows of each table refer to a key."""
    parts = [df.groupBy(F.col(c).alias(key)).agg(F.count("*").alias("n")).withColumn("of", F.lit(name)) for name, (df, c) in references.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(key).pivot("of", list(references)).agg(F.sum("n")).na.fill(0)


def write_if_valid(plan: DataFrame, problems: DataFrame, path: str, dry_run: bool = True) -> DataFrame:
    """The plan, written to a new folder only if no problem was found and it isn't a dry run."""
    if not problems.isEmpty():
        raise ValueError(f"not written: {problems.limit(5).collect()}")
    if not dry_run:
        plan.write.mode("errorifexists").parquet(path)
    return plan


def versioned_copy(table: DataFrame, root: str, version: int) -> DataFrame:
    """``table`` as it is, kept under ``root`` as a version that is never overwritten, and read back from there."""
    path = f"{root}/version={version:06d}"
    table.write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


class Narrowing(TypeError):
    """Versions of a column that no type holds without loss."""


def wider(one: DataType, two: DataType) -> DataType:
    """The type that holds both: of whole numbers the longer, of decimals the digits of both, of fractions the double."""
    whole = [ByteType(), ShortType(), IntegerType(), LongType()]
    if one == two or isinstance(two, NullType):
        return one
    if isinstance(one, NullType):
        return two
    if one in whole and two in whole:
        return whole[max(whole.index(one), whole.index(two))]
    if isinstance(one, DecimalType) and isinstance(two, DecimalType):
        scale = max(one.scale, two.scale)
        digits = max(one.precision - one.scale, two.precision - two.scale)
        if digits + scale <= 38:
            return DecimalType(digits + scale, scale)
    if {type(one), type(two)} <= {FloatType, DoubleType, ByteType, ShortType, IntegerType} and (DoubleType() in (one, two) or FloatType() in (one, two)):
        return DoubleType() if DoubleType() in (one, two) or IntegerType() in (one, two) else FloatType()
    if isinstance(one, ArrayType) and isinstance(two, ArrayType):
        return ArrayType(wider(one.elementType, two.elementType))
    if isinstance(one, StructType) and isinstance(two, StructType):
        return merged_schema([one, two])
    raise Narrowing(f"{one.simpleString()} and {two.simpleString()}")


def merged_schema(schemas: Sequence[StructType]) -> StructType:
    """All columns of ``schemas`` in the order they come up, each of the type that holds all its versions."""
    held: dict[str, DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            try:
                held[f.name] = wider(held[f.name], f.dataType) if f.name in held else f.dataType
            except Narrowing as e:
                raise Narrowing(f"{f.name}: {e}") from None
    return StructType([StructField(n, t) for n, t in held.items()])


def additive(old: StructType, new: StructType) -> StructType:
    """``new`` in front of what is stored as ``old``: it may add columns and widen them, but neither leave one out nor narrow it."""
    out = merged_schema([old, new])
    lost = [f.name for f in old.fields if f.name not in new.names]
    narrowed = [f.name for f in out.fields if f.name in new.names and f.dataType != new[f.name].dataType]
    if lost or narrowed:
        raise Narrowing(f"left out: {lost}; narrowed: {narrowed}")
    return out


def widened(c: Column, old: DataType, new: DataType) -> Column:
    """``c`` as the wider type ``new``; fields that a struct lacks are null."""
    if isinstance(new, StructType) and isinstance(old, StructType):
        fields = [(widened(c[f.name], old[f.name].dataType, f.dataType) if f.name in old.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(new, ArrayType) and isinstance(old, ArrayType):
        return F.transform(c, lambda x: widened(x, old.elementType, new.elementType))
    return c.cast(new)


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """All versions below ``root`` as one table with a column ``version``: columns that a version lacks are null, others are widened.

    Raises ``Narrowing`` if a column's types can't be joined without loss.
    """
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = [f.getPath().toString() for f in top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)]
    parts = {int(p.rpartition("=")[2]): spark.read.parquet(p) for p in sorted(found) if p.rpartition("/")[2].startswith("version=")}
    schema = merged_schema([df.schema for df in parts.values()])
    held = lambda df, f: widened(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
    rows = [df.select(*[held(df, f).alias(f.name) for f in schema.fields], F.lit(v).alias("version")) for v, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def contents(table: DataFrame) -> tuple:
    """Number of rows and the sum of their hashes: equal for equal rows in any order."""
    return tuple(table.agg(F.count("*"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))).first())


def guarded_merge(table: DataFrame, plan: DataFrame, backup: DataFrame | None, problems: DataFrame, path: str) -> DataFrame:
    """``plan`` in place of ``table``, only beside a copy that has all of its rows, and only without problems."""
    if backup is None or not (held := contents(backup.select(*[c for c in table.columns if c in backup.columns])))[0] or held != contents(table):
        raise ValueError("not merged: there is no whole copy of the table")
    return write_if_valid(plan, problems, path, dry_run=False).sparkSession.read.schema(plan.schema).parquet(path)
