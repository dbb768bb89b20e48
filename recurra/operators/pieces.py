"""Series cut into pieces: numbering, and the rows before (and after) a piece that its windows reach, so that no task holds a series."""

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.plans.catalog import STRETCH


def numbered(rows: DataFrame, *by: str, name: str = "rn") -> DataFrame:
    """rows with their number (from 0) in each series of `by`, in the order of epoch and id.

    Rows are numbered within stretches of time, and a row for each stretch says how many stand before it.
    """
    cut = rows.withColumn("stretch", F.floor(F.col("epoch") / STRETCH))
    counts = cut.groupBy(*by, "stretch").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*by, "stretch").orderBy("epoch", "id")) - 1
    return cut.withColumn(name, own).join(counts, [*by, "stretch"]).withColumn(name, F.col(name) + F.col("before")).drop("stretch", "before")


def reached(number: str, size: int, back: int, ahead: int = 0) -> Column:
    """The pieces (of `size` rows) whose own rows or whose `back` rows before and `ahead` rows after hold this one."""
    n = F.col(number)
    return F.explode(F.sequence(F.greatest(F.floor((n - ahead) / size), F.lit(0)), F.floor((n + back) / size)))


def framed(rows: DataFrame, by: str, back: int, columns, size: int = 20_000) -> DataFrame:
    """rows and what columns(window) gives, by name, over the `back` rows before each and itself, in the order of epoch and id; rn: the row's number.

    The windows work in pieces of `size` rows with the rows before that they reach.
    """
    cut = numbered(rows, by).withColumn("piece", reached("rn", size, back))
    order = Window.partitionBy(by, "piece").orderBy("rn")
    out = cut.select("*", *[c.alias(name) for name, c in columns(order.rowsBetween(-back, 0)).items()])
    return out.where(F.floor(F.col("rn") / size) == F.col("piece")).drop("piece")


def carried(rows: DataFrame, by: str, t: str, side: str, columns: dict[str, Column], ahead: bool = False, itself: bool = True) -> DataFrame:
    """rows and, for each of columns, its newest value that is not null up to each row; ahead: the first from it on; itself: whether the row's own counts.

    Rows follow t (in seconds) and side.  Within a stretch of time a window looks; what it needs of the time before (ahead: after) is one
    row of a small table with a row for each stretch.
    """
    cut = rows.select("*", F.floor(F.col(t) / STRETCH).alias("stretch"), *[c.alias(f"own_{n}") for n, c in columns.items()])
    place = lambda n: F.when(F.col(f"own_{n}").isNotNull(), F.struct(t, side))
    edge = cut.groupBy(by, "stretch").agg(*[(F.min_by if ahead else F.max_by)(f"own_{n}", place(n)).alias(n) for n in columns])
    far = Window.partitionBy(by).orderBy(F.desc("stretch") if ahead else "stretch").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(by, "stretch", *[F.last(n, True).over(far).alias(f"far_{n}") for n in columns])
    near = Window.partitionBy(by, "stretch").orderBy(*((F.desc(t), F.desc(side)) if ahead else (t, side))).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    out = cut.join(edge, [by, "stretch"])
    return out.select(*rows.columns, *[F.coalesce(F.last(f"own_{n}", True).over(near), F.col(f"far_{n}")).alias(n) for n in columns])


def kept(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir, for what is dear and used more than once; a folder of our own only where none is set and all runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="recurra"))
    return df.checkpoint()
