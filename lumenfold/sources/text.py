"""Text sources: scan runlists and split definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = "scanid long, mjd_start double, mjd_stop double, scantype int"


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Scan lines of runlists: an eight-digit id, start, stop and type. Headers have other shapes."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).filter((F.size("p") >= 4) & F.rlike(F.col("p")[0], F.lit("^[0-9]{8,}$")))
    return lines.select(F.col("p")[0].cast("long").alias("scanid"), F.col("p")[1].cast("double").alias("mjd_start"), F.col("p")[2].cast("double").alias("mjd_stop"), F.col("p")[3].cast("int").alias("scantype"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Split definitions: a four-character name, a type (2 primary, 3 secondary), 1 for a cross
    variable, $ for a temporal split; # starts a comment."""
    code = F.trim(F.split("value", "#")[0])
    p = F.split(code, r"\s+")
    rows = spark.read.text(path).select(code.alias("code"), p.alias("p")).filter(F.rlike("code", F.lit(r"^\S{4}\s+[23](\s|$)")))
    return rows.select(F.col("p")[0].alias("name"), F.col("p")[1].cast("int").alias("type"), F.array_contains(F.slice("p", 3, 9), "1").alias("cross"), F.contains("code", F.lit("$")).alias("temporal"))


def split_roles(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The variables of a split definition file by what each use of it needs, in the file's order.

    bits: those that halve scans, in the order of their bits from 1 (temporal ones have none); primary, secondary and temporal: what maps are
    made for; cross, cross_primary and cross_secondary: what spectra are crossed over. A file is read as one piece; it is a few dozen lines.
    """
    lines = [line for row in spark.read.text(path, wholetext=True).collect() for line in row[0].split("\n")]
    roles: dict[str, list[str]] = {k: [] for k in ("bits", "primary", "secondary", "temporal", "cross", "cross_primary", "cross_secondary")}
    for line in lines:
        code = line.split("#")[0]
        words = code.split("$")[0].split()
        if len(words) < 2 or len(words[0]) != 4 or words[1] not in ("2", "3"):
            continue
        name, kind = words[0], "primary" if words[1] == "2" else "secondary"
        roles[kind].append(name)
        roles["temporal" if "$" in code else "bits"].append(name)
        if len(words) > 2 and words[-1] == "1":
            roles["cross"].append(name)
            roles[f"cross_{kind}"].append(name)
    return roles


def read_profile(spark: SparkSession, radius_path: str, value_path: str) -> DataFrame:
    """A radial profile from two text files of a number a line, which lie side by side: r and value."""
    def column(path: str, name: str) -> DataFrame:
        text = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("at", "x"))
        return text.select("at", F.col("x").cast("double").alias(name))

    return column(radius_path, "r").join(column(value_path, "value"), "at").drop("at")


def read_runlist(spark: SparkSession, path: str) -> DataFrame:
    """Scans of runlist files with what stands in the headers above them: scanid, mjd_start, mjd_stop, scantype, field, obsid, file.

    A file is a number of fields, then per field `name observations`, per observation `id start stop scans
    path`, and per scan `id start stop type ...`. A line's kind shows in its shape; a file is laid out in one
    task in its own order, as one scan catalogue is small.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.posexplode(F.split("value", "\n")).alias("_at", "_line"))
    p = text.withColumn("p", F.split(F.trim("_line"), r"\s+"))
    first, n = F.col("p")[0], F.size("p")
    is_scan = F.rlike(first, F.lit("^[0-9]{8,}$")) & (n >= 4)
    is_obs = F.rlike(first, F.lit("^[0-9]{4,7}$")) & (n >= 5)
    is_field = F.rlike(first, F.lit("^[A-Za-z]")) & (n == 2)
    w = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = p.withColumn("field", F.last(F.when(is_field, first), ignorenulls=True).over(w)).withColumn("_obs", F.last(F.when(is_obs, F.col("p")), ignorenulls=True).over(w))
    return rows.filter(is_scan).select(
        first.cast("long").alias("scanid"), F.col("p")[1].cast("double").alias("mjd_start"), F.col("p")[2].cast("double").alias("mjd_stop"), F.col("p")[3].cast("double").cast("int").alias("scantype"),
        "field", F.col("_obs")[0].cast("long").alias("obsid"), F.ltrim(F.element_at("_obs", -1), F.lit("/")).alias("file"),
    )


def write_runlist(scans: DataFrame, path: str) -> None:
    """Write scans (field, obsid, file, scanid, mjd_start, mjd_stop, scantype, mean_az, mean_el, std_el, bits) as a runlist, of one text file.

    The lines are as many as a catalogue's; their order is a sort by field, observation and scan.
    """
    obs = scans.groupBy("field", "obsid").agg(F.min("mjd_start").alias("a"), F.max("mjd_stop").alias("b"), F.count("*").alias("n"), F.min("file").alias("file"))
    fields = obs.groupBy("field").agg(F.count("*").alias("n"))
    line = [
        fields.agg(F.count("*").alias("n")).select(F.lit("").alias("field"), F.lit(-1).cast("long").alias("obsid"), F.lit(-1).cast("long").alias("scanid"), F.format_string("%d", "n").alias("line")),
        fields.select("field", F.lit(-1).cast("long").alias("obsid"), F.lit(-1).cast("long").alias("scanid"), F.format_string("%s   %d", "field", "n").alias("line")),
        obs.select("field", "obsid", F.lit(-1).cast("long").alias("scanid"), F.format_string("  %06d %17.10f %17.10f %02d %s", "obsid", "a", "b", "n", "file").alias("line")),
        scans.select("field", "obsid", "scanid", F.concat(
            F.format_string("     %08d %17.10f %17.10f %d %10.6f %10.6f %10.6f", "scanid", "mjd_start", "mjd_stop", "scantype", "mean_az", "mean_el", "std_el"),
            F.array_join(F.transform("bits", lambda b: F.concat(F.lit(" "), b.cast("string"))), ""),
        ).alias("line")),
    ]
    rows = line[0]
    for more in line[1:]:
        rows = rows.unionByName(more)
    rows.orderBy("field", "obsid", "scanid").coalesce(1).select("line").write.mode("overwrite").text(path)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a patch file: name, ra, dec, radius_ra, radius_dec, resolution, kind. Headers have no number second; names with x are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).filter((F.size("p") >= 7) & F.rlike(F.col("p")[1], F.lit("^[-+0-9.]+$")) & ~F.contains(F.col("p")[0], F.lit("x")))
    numbers = [F.col("p")[i + 1].cast("double").alias(n) for i, n in enumerate(("ra", "dec", "radius_ra", "radius_dec", "resolution"))]
    return rows.select(F.col("p")[0].alias("name"), *numbers, F.col("p")[6].alias("kind"))


def read_parameters(path: str) -> dict[str, list[str]]:
    """A parameter file of `--name value value ...` lines: the values by name. # starts a comment."""
    out: dict[str, list[str]] = {}
    with open(path) as lines:
        words = " ".join(line.split("#")[0] for line in lines).split()
    name = None
    for word in words:
        if word.startswith("--"):
            name = word[2:]
            out[name] = []
        elif name is not None:
            out[name].append(word)
    return out
