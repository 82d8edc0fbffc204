"""Import statements of Python and Go files, read line by line, and their rewriting below local roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOUND = "array<struct<line:int,statement:string>>"


def _numbered(text: Column) -> Column:
    return F.transform(F.split(text, "\r?\n", -1), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text")))


def _state(**parts: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def _added(out: Column, line: Column, statement: Column) -> Column:
    return F.concat(out, F.array(F.struct(line.cast("int").alias("line"), statement.alias("statement"))).cast(_FOUND))


def _python_statements(text: Column) -> Column:
    """line and statement of the import statements of a text.

    An automaton goes over the lines: quote is the triple quote that is open, open the statement that
    goes on (in brackets, or after a backslash) with the line it began on. Lines within a long string
    say nothing; a statement that never ends is dropped.
    """
    none = F.lit("")

    def step(a: Column, x: Column) -> Column:
        line = x["text"]
        bare = F.trim(F.regexp_replace(line, r"\s*#.*$", ""))
        whole = F.trim(F.concat_ws(" ", F.rtrim(a["open"], F.lit("\\")), bare))
        starts = line.rlike(r"^\s*(import|from)\s+[\w.]")
        unclosed = whole.contains("(") & ~whole.contains(")")
        goes_on = unclosed | whole.endswith("\\")
        began = F.when(a["open"] != "", a["at"]).otherwise(x["line"])
        left = F.regexp_replace(line, "(\"{3}.*?\"{3})|('{3}.*?'{3})|(^\\s*#.*)", "")
        opened = F.regexp_extract(left, "(\"{3}|'{3})", 1)
        in_string = _state(quote=F.when(line.contains(a["quote"]), none).otherwise(a["quote"]), open=none, at=a["at"], out=a["out"])
        in_statement = F.when(goes_on, _state(quote=none, open=whole, at=began, out=a["out"])).otherwise(_state(quote=none, open=none, at=began, out=_added(a["out"], began, whole)))
        return F.when(a["quote"] != "", in_string).when((a["open"] != "") | starts, in_statement).otherwise(_state(quote=opened, open=none, at=a["at"], out=a["out"]))

    start = _state(quote=none, open=none, at=F.lit(0), out=F.array().cast(_FOUND))
    return F.aggregate(_numbered(text), start, step, lambda a: a["out"])


def _go_statements(text: Column) -> Column:
    """line and statement (a quoted path) of the imports of a text: single ones and those of blocks.
    Comments over several lines say nothing."""
    path = "[\"`]([^\"`]+)[\"`]"

    def step(a: Column, x: Column) -> Column:
        line = F.regexp_replace(x["text"], r"/\*.*?\*/", " ")
        bare = F.regexp_replace(line, "^(?:([^\"`/]*(?:[\"`][^\"`]*[\"`][^\"`/]*)*))//.*$", "$1")
        opens = bare.contains("/*")
        single = F.regexp_extract(bare, rf"^\s*import\s+(?:[\w.]+\s+)?{path}", 1)
        within = F.regexp_extract(bare, rf"^\s*(?:import\s*\(\s*)?(?:[\w.]+\s+)?{path}", 1)
        begins = bare.rlike(r"^\s*import\s*\(")
        found = F.when(a["block"] | begins, within).otherwise(single)
        out = F.when(found != "", _added(a["out"], x["line"], found)).otherwise(a["out"])
        block = (a["block"] | begins) & ~F.regexp_replace(bare, path, "").contains(")")
        inside = _state(comment=~x["text"].contains("*/"), block=a["block"], out=a["out"])
        return F.when(a["comment"], inside).otherwise(_state(comment=opens, block=block, out=out))

    start = _state(comment=F.lit(False), block=F.lit(False), out=F.array().cast(_FOUND))
    return F.aggregate(_numbered(text), start, step, lambda a: a["out"])


def python_imports(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line and specifier of what Python files import, each specifier once a line.

    Relative modules become paths (./sibling, ../parent/module), as do the names that are imported
    from a package by dots alone; absolute ones keep their dots. A null text imports nothing.
    """
    found = files.select(key, F.explode(_python_statements(F.coalesce(F.col(text), F.lit("")))).alias("s")).select(key, "s.line", F.explode(F.split("s.statement", ";")).alias("statement"))
    found = found.withColumn("statement", F.trim("statement"))
    form = r"^from\s+(\.*)\s*([\w.]*)\s*import\s+\(?([^)]*)\)?"
    dots, module = F.length(F.regexp_extract("statement", form, 1)), F.regexp_extract("statement", form, 2)
    listed = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_extract(x, r"^\s*([\w.]+)", 1)), lambda x: x != "")
    names = listed(F.regexp_extract("statement", form, 3))
    lead = F.when(dots == 1, "./").otherwise(F.repeat(F.lit("../"), dots - 1))
    as_path = lambda m: F.concat(lead, F.replace(m, F.lit("."), F.lit("/")))
    plain = listed(F.regexp_extract("statement", r"^import\s+(.*)$", 1))
    many = F.when(~F.col("statement").rlike(form), plain).when(dots == 0, F.array(module)).when(module != "", F.array(as_path(module))).otherwise(F.transform(names, as_path))
    return found.select(key, "line", F.explode(many).alias("specifier")).distinct()


def go_imports(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line and specifier of what Go files import, each specifier once a line."""
    return files.select(key, F.explode(_go_statements(F.coalesce(F.col(text), F.lit("")))).alias("s")).select(key, "s.line", F.col("s.statement").alias("specifier")).distinct()


def relative_path(from_path: Column, target: Column) -> Column:
    """The way from a file's folder to a path, ./ or ../ first; "." for the folder itself."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    folder, to = parts(F.regexp_replace(from_path, "/?[^/]*$", "")), parts(target)
    shared = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(folder), F.size(to))), lambda k: F.slice(folder, 1, k) == F.slice(to, 1, k))) - 1
    up = F.size(folder) - shared
    rest = F.array_join(F.slice(to, shared + 1, F.size(to)), "/")
    way = F.concat(F.when(up > 0, F.repeat(F.lit("../"), up)).otherwise("./"), rest)
    return F.when((up == 0) & (rest == ""), ".").otherwise(F.rtrim(way, F.lit("/")))


def below_roots(imports: DataFrame, roots: DataFrame, separator: str, path: str = "path") -> DataFrame:
    """The imports with specifiers below a local root rewritten to the way from the file to it.

    roots: name and root (a folder) of local packages or modules. Of the roots that are a specifier, or
    its beginning up to a separator, the longest name holds. Each specifier is a row for each of its
    beginnings, which meet the names by an equal join; others, and relative ones, stay as they are.
    """
    local = imports.select("specifier").distinct().filter(~F.col("specifier").startswith("."))
    parts = F.split("specifier", r"\Q" + separator + r"\E")
    prefixes = local.select("specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), separator))).alias("name"))
    best = prefixes.join(roots.select("name", "root"), "name").groupBy("specifier").agg(F.max_by(F.struct("name", "root"), F.struct(F.length("name"), "name", "root")).alias("r"))
    met = imports.join(best, "specifier", "left")
    rest = F.replace(F.substring(F.col("specifier"), F.length("r.name") + 2, F.length("specifier")), F.lit(separator), F.lit("/"))
    way = relative_path(F.col(path), F.concat_ws("/", "r.root", rest))
    return met.withColumn("specifier", F.when(F.col("r").isNotNull(), way).otherwise(F.col("specifier"))).select(*imports.columns)
