"""Source trees, manifests and git output as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.ids import package_of

# Folders that are never listed.
PRUNED = ("node_modules", ".git", "dist", "build", "coverage", ".next", "out", "vendor", ".turbo", ".cache", ".svelte-kit", ".nuxt")
MAX_ANALYSED = 2 * 1024 * 1024


def folders_below(spark: SparkSession, root: str, max_depth: int = 100) -> list[str]:
    """The folder and those below it, by Hadoop's listing, without pruned ones, links and what is
    deeper than max_depth. Files are not listed one by one."""
    context = spark.sparkContext
    path_of = context._jvm.org.apache.hadoop.fs.Path
    files = path_of(root).getFileSystem(context._jsc.hadoopConfiguration())
    found, open_ = [], [(path_of(root), 0)]
    while open_:
        folder, depth = open_.pop()
        found.append(folder.toString())
        below = [s for s in files.listStatus(folder) if s.isDirectory() and not s.isSymlink() and s.getPath().getName() not in PRUNED]
        open_ += [(s.getPath(), depth + 1) for s in below if depth < max_depth]
    return sorted(found)


def read_tree(spark: SparkSession, root: str, max_depth: int = 100) -> DataFrame:
    """relative_path, modified_at, size_bytes, content of every file below a folder that Spark can
    read. Pruned folders are not entered; the content of files too large to be analysed is null and
    not read."""
    places = folders_below(spark, root, max_depth)
    every = spark.read.format("binaryFile").load(places)
    large = every.filter(F.col("length") > MAX_ANALYSED).select("path", "modificationTime", "length").withColumn("content", F.lit(None).cast("binary"))
    files = every.filter(F.col("length") <= MAX_ANALYSED).unionByName(large)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_extract("path", r"^[a-z]+:/*(.*)$", 1)
    relative = F.expr("substring(p, length(b) + 2)")
    named = files.withColumn("p", path).withColumn("b", F.lit(base)).withColumn("relative_path", relative)
    return named.select("relative_path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), "content")


def encoding_of(content: Column) -> Column:
    """utf-8, utf-16le or utf-16be by the byte order mark; utf-8 without one; null for bytes that are
    no text: a NUL or bytes that do not decode."""
    head = F.hex(F.substring(content, 1, 3))
    bare = F.is_valid_utf8(content.cast("string")) & (F.position(F.lit("\0"), content.cast("string")) == 0)
    return F.when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").when(bare, "utf-8")


def decoded(content: Column) -> Column:
    """The text without its byte order mark; null if it is none."""
    kind = encoding_of(content)
    text = F.when(kind == "utf-16le", F.decode(F.substring(content, 3, MAX_ANALYSED), "UTF-16LE")).when(kind == "utf-16be", F.decode(F.substring(content, 3, MAX_ANALYSED), "UTF-16BE")).when(kind == "utf-8", F.decode(content, "UTF-8"))
    return F.regexp_replace(text, "^\ufeff", "")


def classified(tree: DataFrame) -> DataFrame:
    """Adds status (eligible, oversize, binary), sha256 of the bytes, and text of what is eligible."""
    status = F.when(F.col("size_bytes") > MAX_ANALYSED, "oversize").when(encoding_of(F.col("content")).isNull(), "binary").otherwise("eligible")
    return tree.withColumn("status", status).withColumn("sha256", F.sha2("content", 256)).withColumn("text", F.when(F.col("status") == "eligible", decoded(F.col("content")))).drop("content")


def declared_packages(manifests: DataFrame, text: str = "text") -> DataFrame:
    """The distinct packages of the four dependency sections of package manifests."""
    section = "map<string,string>"
    parsed = F.from_json(text, f"dependencies {section}, devDependencies {section}, peerDependencies {section}, optionalDependencies {section}")
    names = F.flatten(F.array(*(F.coalesce(F.map_keys(parsed[s]), F.array().cast("array<string>")) for s in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))))
    return manifests.select(F.explode(names).alias("package")).distinct()


def external_packages(specifiers: DataFrame, column: str = "specifier") -> DataFrame:
    """The distinct packages that bare specifiers name."""
    bare = specifiers.filter(~F.col(column).rlike(r"^[./]") & ~F.col(column).startswith("node:"))
    return bare.select(package_of(F.col(column)).alias("package")).distinct()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """value, a commit's lines, of "git log --numstat --format=%x1e%H%x09%at" output: the record mark
    lets Spark split a log between commits."""
    return spark.read.option("lineSep", "\x1e").text(path).filter(F.trim("value") != "")


def numstat(log: DataFrame, record: str = "value") -> DataFrame:
    """commit, day, path, additions, deletions of each file of each commit of read_log(). "-" counts as
    0, a rename by its new path."""
    lines = F.split(F.col(record), "\r?\n")
    head = r"^([0-9a-f]{7,40})\t(\d+)$"
    rows = log.select(F.regexp_extract(lines[0], head, 1).alias("commit"), F.timestamp_seconds(F.regexp_extract(lines[0], head, 2).try_cast("long")).alias("day"), F.explode(F.slice(lines, 2, 1 << 30)).alias("line"))
    row = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    number = lambda k: F.coalesce(F.regexp_extract("line", row, k).try_cast("long"), F.lit(0))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("line", row, 3), r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    return rows.filter((F.col("commit") != "") & F.col("line").rlike(row)).select("commit", "day", F.regexp_replace(path, "//", "/").alias("path"), number(1).alias("additions"), number(2).alias("deletions"))


def name_status(diff: DataFrame, line: str = "value") -> DataFrame:
    """change, path, old_path of "git diff --name-status" lines."""
    kind = F.substring(line, 1, 1)
    parts = F.split(F.col(line), "\t")
    named = F.element_at(F.create_map(*(F.lit(x) for kv in {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "copied", "T": "modified"}.items() for x in kv)), kind)
    return diff.filter(F.size(parts) > 1).select(named.alias("change"), F.element_at(parts, -1).alias("path"), F.when(F.size(parts) > 2, parts[1]).alias("old_path"))


def guarded_text(files: DataFrame, text: str = "text", max_bytes: int = 1024 * 1024, max_lines: int = 8000) -> DataFrame:
    """Adds lines (their number) and unavailable: why a text is not shown (missing, oversize, too-many-lines),
    or null."""
    lines = F.size(F.split(text, "\r?\n", -1))
    reason = F.when(F.col(text).isNull(), "missing").when(F.octet_length(text) > max_bytes, "oversize").when(lines > max_lines, "too-many-lines")
    return files.withColumn("lines", F.when(F.col(text).isNotNull(), lines)).withColumn("unavailable", reason)


def content_states(texts: DataFrame, known: DataFrame) -> DataFrame:
    """path, content_hash and state (new, changed, unchanged or gone) of texts against stored hashes.

    texts: path and text, decoded; known: path and content_hash. A null text has no hash and is as one
    that can't be read: changed, if its path is known. Paths are unique on both sides."""
    now = texts.select("path", F.sha2("text", 256).alias("content_hash"), F.lit(True).alias("_now"))
    met = now.join(known.select("path", F.col("content_hash").alias("_old"), F.lit(True).alias("_known")), "path", "full")
    state = F.when(F.col("_now").isNull(), "gone").when(F.col("_known").isNull(), "new").when(F.col("content_hash") == F.col("_old"), "unchanged").otherwise("changed")
    return met.select("path", "content_hash", state.alias("state"))
