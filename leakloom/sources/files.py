"""Files as rows, path globs, and the list of repositories."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never entered, and patterns of files that hold no text.
SKIPPED_FOLDERS = (".git", "node_modules", "vendor", ".cache")
BINARY = ("*.png", "*.jpg", "*.jpeg", "*.gif", "*.webp", "*.ico", "*.pdf", "*.7z", "*.exe", "*.dll", "*.so", "*.dylib")
PACKED = ("*.zip", "*.tar", "*.gz", "*.tgz")
MAX_FILE = 25 << 20
SNIFF = 8000


def glob_pattern(glob: str) -> str | None:
    """A regular expression of a glob whose wildcards stay inside a folder; None if it is malformed."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 1)
            if end < 0 or glob[i:end] in ("", "^"):
                return None
            out.append("[" + glob[i:end].replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end + 1
        elif c == "\\":
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
            i += 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def matches(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether a relative path, or its last part, is one of the globs; blank and malformed ones match nothing."""
    own = [p for g in globs if g.strip() and (p := glob_pattern(g.strip())) is not None]
    if not own:
        return F.lit(False)
    whole = rf"^(?s:{'|'.join(own)})\z"
    return path.rlike(whole) | F.substring_index(path, "/", -1).rlike(whole)


def allowed(path: Column, include: list[str] = (), exclude: list[str] = (), archives: bool = False) -> Column:
    """Included (if anything is), no default exclusion, no own one."""
    out = ~matches(path, [*BINARY, *(() if archives else PACKED)]) & ~matches(path, exclude)
    return out & matches(path, include) if any(g.strip() for g in include) else out


def path_filter(include: list[str] = (), exclude: list[str] = (), archives: bool = False) -> Callable[[str], bool]:
    """``allowed`` for single paths."""

    def any_of(globs: list[str]) -> re.Pattern[str] | None:
        own = [p for g in globs if g.strip() and (p := glob_pattern(g.strip())) is not None]
        return re.compile(f"(?s:{'|'.join(own)})") if own else None

    def hit(pattern: re.Pattern[str] | None, path: str) -> bool:
        return pattern is not None and bool(pattern.fullmatch(path) or pattern.fullmatch(path.rsplit("/", 1)[-1]))

    out, only, all_in = any_of([*BINARY, *(() if archives else PACKED), *exclude]), any_of(list(include)), not any(g.strip() for g in include)
    return lambda path: not hit(out, path) and (all_in or hit(only, path))


def is_binary(content: Column) -> Column:
    """A NUL byte in the first 8000 bytes."""
    return F.instr(F.decode(F.substring(content, 1, SNIFF), "ISO-8859-1"), "\x00") > 0


def archive_kind(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".zip"), "zip").when(p.endswith(".tar.gz") | p.endswith(".tgz"), "targz").when(p.endswith(".tar"), "tar").when(p.endswith(".gz"), "gz").otherwise("")


def listed(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), max_file: int = MAX_FILE, archives: bool = False) -> DataFrame:
    """(path, file, commit, length, content) of the files below a folder; what is filtered by path and size is never read, nor is any content that isn't used."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    prefix = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    rel = F.expr(f"substring(path, instr(path, {_sql(prefix)}) + {len(prefix)})")
    folders = "|".join(map(re.escape, SKIPPED_FOLDERS))
    rows = base.where(F.col("length") <= max_file).withColumn("file", rel)
    rows = rows.where(allowed(F.col("file"), list(include), list(exclude), archives) & ~F.col("file").rlike(rf"(?:^|/)(?:{folders})/"))
    return rows.select("path", "file", F.lit("").alias("commit"), "length", "content")


def read_folder(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), max_file: int = MAX_FILE, archives: bool = False) -> DataFrame:
    """(file, commit, content) of the files below a folder."""
    return listed(spark, root, include, exclude, max_file, archives).select("file", "commit", "content")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A single file: neither globs nor the size limit hold."""
    return spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), F.lit("").alias("commit"), "content")


def targets_of(lines: DataFrame) -> DataFrame:
    """The targets that lines (``value``) name."""
    return lines.select(F.btrim("value").alias("target")).where("target <> '' AND NOT startswith(target, '#')").distinct()


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a list: trimmed, without blanks, comments and repeats; an empty list is an error."""
    rows = targets_of(spark.read.text(path))
    if rows.isEmpty():
        raise ValueError(f"{path} names no repository")
    return rows


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
