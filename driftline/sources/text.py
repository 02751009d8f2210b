"""PDB, GRO and XYZ text: fixed columns cut by Spark expressions, one row for each line.

A file is read by Spark's text source, whole (``wholetext``), as frames are
found by counting records from its start; many files are read in parallel, and
``frame`` counts from 0 inside each ``path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n (from 0), line of every line."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("n", "line"))
    return lines.withColumn("n", F.col("n").cast("long"))


def _cut(first: int, last: int, kind: str = "string") -> Column:
    """Columns first..last, from 1, trimmed; empty ones are null."""
    text = F.trim(F.substring("line", first, last - first + 1))
    return F.when(text != "", text).cast(kind)


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, atom and the fields of ATOM and HETATM records; every MODEL begins a frame."""
    w = Window.partitionBy("path").orderBy("n")
    model = F.sum(F.col("line").startswith("MODEL").cast("long")).over(w)
    rows = _lines(spark, path).withColumn("frame", F.greatest(model - 1, F.lit(0))).where(F.col("line").rlike("^(ATOM  |HETATM)"))
    atom = (F.row_number().over(Window.partitionBy("path", "frame").orderBy("n")) - 1).cast("long")
    element = F.coalesce(_cut(77, 78), F.upper(F.regexp_extract(_cut(13, 16), "([A-Za-z])", 1)))
    return rows.select(
        "path", "frame", atom.alias("atom"), _cut(7, 11, "long").alias("serial"), F.upper(_cut(13, 16)).alias("name"), F.upper(_cut(18, 20)).alias("resname"),
        F.upper(F.coalesce(_cut(22, 22), F.lit(""))).alias("chain"), _cut(23, 26, "long").alias("resid"), *[_cut(a, a + 7, "double").alias(c) for c, a in zip("xyz", (31, 39, 47), strict=True)],
        _cut(55, 60, "double").alias("occupancy"), _cut(61, 66, "double").alias("bfactor"), F.upper(element).alias("element"),
    )


def _heads(lines: Column, count_at: int, extra: int) -> Column:
    """First line of each frame, which holds a number of atoms at ``count_at``, as many lines and ``extra`` others.

    A frame's head follows from the one before, so what stands in other lines doesn't matter.
    """
    state = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))
    count = lambda i: F.regexp_extract(F.get(lines, i + count_at), r"^\s*(\d+)\s*$", 1)

    def step(acc: Column, i: Column) -> Column:
        here = (i == acc["next"]) & (F.coalesce(count(i), F.lit("")) != "")
        return F.when(here, F.struct((i + extra + count(i).cast("int")).alias("next"), F.concat(acc["at"], F.array(i)).alias("at"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), state, step)["at"]


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, atom, names, coordinates and box in angstrom (files hold nm), time from the title."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    rows = whole.select("path", "lines", F.posexplode(_heads(F.col("lines"), 1, 3)).alias("frame", "at"))
    n = F.trim(F.get(F.col("lines"), F.col("at") + 1)).cast("int")
    rows = rows.select("path", F.col("frame").cast("long").alias("frame"), F.regexp_extract(F.get(F.col("lines"), F.col("at")), r"t=\s*([-0-9.eE+]+)", 1).alias("t"), F.split(F.trim(F.get(F.col("lines"), F.col("at") + 2 + n)), r"\s+").alias("box"), F.posexplode(F.slice("lines", F.col("at") + 3, n)).alias("atom", "line"))
    return rows.select(
        "path", "frame", F.col("atom").cast("long").alias("atom"), F.when(F.col("t") != "", F.col("t")).cast("double").alias("time_ps"), _cut(1, 5, "long").alias("resid"),
        F.upper(_cut(6, 10)).alias("resname"), F.upper(_cut(11, 15)).alias("name"), *[(_cut(a, a + 7, "double") * 10.0).alias(c) for c, a in zip("xyz", (21, 29, 37), strict=True)],
        *[(F.col("box")[i].cast("double") * 10.0).alias(f"l{c}") for i, c in enumerate("xyz")],
    )


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, atom, element, x, y, z; frames are a count, a comment of any kind and that many atoms."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    rows = whole.select("path", "lines", F.posexplode(_heads(F.col("lines"), 0, 2)).alias("frame", "at"))
    n = F.trim(F.get(F.col("lines"), F.col("at"))).cast("int")
    rows = rows.select("path", F.col("frame").cast("long").alias("frame"), F.posexplode(F.slice("lines", F.col("at") + 3, n)).alias("atom", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    return rows.select("path", "frame", F.col("atom").cast("long").alias("atom"), F.upper(parts[0]).alias("element"), *[parts[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])


def read_g96(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, atom, step, time_ps, coordinates and box in angstrom (files hold nm) of GROMOS96 blocks.

    A frame ends with the block of its positions (POSITION, POSITIONRED) or the
    velocities or box after it: each TIMESTEP, or else each position block, begins one.
    """
    w = Window.partitionBy("path").orderBy("n")
    lines = _lines(spark, path).withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    names = ["TITLE", "TIMESTEP", "POSITION", "POSITIONRED", "VELOCITY", "VELOCITYRED", "BOX"]
    opens = F.col("line").isin(names)
    lines = lines.withColumns({"name": F.last(F.when(opens, F.col("line")), True).over(w), "opens": opens, "block": F.max(F.when(opens, F.col("n"))).over(w)})
    timed = F.max((F.col("line") == "TIMESTEP").cast("int")).over(Window.partitionBy("path"))
    begins = F.when(timed == 1, F.col("line") == "TIMESTEP").otherwise(F.col("line").isin("POSITION", "POSITIONRED"))
    lines = lines.withColumn("frame", F.sum(begins.cast("long")).over(w) - 1).where(~F.col("opens") & (F.col("line") != "END"))
    parts = F.split("line", r"\s+")
    last = lambda k: F.element_at(parts, -k).cast("double") * 10.0
    at = lines.where(F.col("name").isin("POSITION", "POSITIONRED"))
    atoms = at.select("path", "frame", (F.row_number().over(Window.partitionBy("path", "block").orderBy("n")) - 1).cast("long").alias("atom"), last(3).alias("x"), last(2).alias("y"), last(1).alias("z"))
    times = lines.where("name = 'TIMESTEP'").groupBy("path", "frame").agg(F.first(parts[0].cast("long")).alias("step"), F.first(parts[1].cast("double")).alias("time_ps"))
    boxes = lines.where("name = 'BOX'").groupBy("path", "frame").agg(*[F.first(parts[k].cast("double") * 10.0).alias(f"l{c}") for k, c in enumerate("xyz")])
    return atoms.join(times, ["path", "frame"], "left").join(boxes, ["path", "frame"], "left")


def read_ndx(spark: SparkSession, path: str) -> DataFrame:
    """path, name, position, atom (from 0) of the groups of an index file, whose numbers are from 1."""
    w = Window.partitionBy("path").orderBy("n")
    head = F.regexp_extract("line", r"^\s*\[\s*(.*?)\s*\]", 1)
    lines = _lines(spark, path).withColumn("line", F.regexp_replace("line", ";.*", ""))
    lines = lines.select("path", "n", "line", F.last(F.when(F.col("line").rlike(r"^\s*\["), head), True).over(w).alias("name"))
    numbers = lines.where(F.col("line").rlike(r"^\s*\d")).select("path", "name", "n", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("k", "atom"))
    position = F.row_number().over(Window.partitionBy("path", "name").orderBy("n", "k")) - 1
    return numbers.select("path", "name", position.cast("long").alias("position"), (F.col("atom").cast("long") - 1).alias("atom"))


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """frame, atom, value: a PDB line for each atom (frame, atom, name, resname, chain, resid, x, y, z, element)."""
    line = F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.col("atom") + 1, F.concat(F.lit(" "), "name"), "resname", "chain", F.col("resid").cast("int"), "x", "y", "z", F.lit(1.0), F.lit(0.0), "element")
    return atoms.select("frame", "atom", line.alias("value"))


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result as parquet, csv or json."""
    writer = df.write.mode("error")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
