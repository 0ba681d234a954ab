"""Sources: trees of files, zip archives, uploads and stored artifacts as a table (repo, path, content, bytes) and one of skipped files.

Nothing is unpacked to disk and no code is run; every check but the unpacking itself is a column predicate. All tables are keyed by
``repo``, so that many repositories are read, checked and ranked side by side.
"""

from __future__ import annotations

import fnmatch
import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.columns import name_of, parent_of, suffix_of
from ..functions.prefix import running_total
from ..functions.scratch import cut, small


@dataclass(frozen=True)
class Limits:
    files: int = fixed.MAX_FILES
    file_bytes: int = fixed.MAX_FILE_BYTES
    archive_bytes: int = fixed.MAX_ARCHIVE_BYTES
    extracted_bytes: int = fixed.MAX_EXTRACTED_BYTES


def in_ignored_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, fixed.IGNORED_DIRS)))


def is_candidate(path: Column) -> Column:
    return name_of(path).isin(fixed.SPECIAL_NAMES) | suffix_of(path).isin(fixed.SUFFIXES)


def is_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.substring(content, 1, 8192).cast("string").contains("\0")


def decoded(content: Column) -> Column:
    """UTF-8 with replacement characters, line ends as \\n."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def gitignore_rules(raw: DataFrame) -> DataFrame:
    """(repo, base, pattern, negated, dir_only, ord) from all .gitignore files of (repo, path, content). Nested files come after outer ones."""
    lines = raw.where(name_of(F.col("path")) == ".gitignore").select("repo", parent_of(F.col("path")).alias("base"), F.posexplode(F.split(decoded(F.col("content")), "\n")).alias("n", "line"))
    line = F.trim("line")
    body = F.trim(F.when(line.startswith("!"), F.substring(line, 2, 10**6)).otherwise(line))
    rules = lines.where((line != "") & ~line.startswith("#")).select("repo", "base", "n", line.startswith("!").alias("negated"), body.endswith("/").alias("dir_only"), F.replace(F.regexp_replace(body, "/+$", ""), F.lit("\\"), F.lit("/")).alias("body"))
    order = F.struct(F.size(F.filter(F.split("base", "/"), lambda x: x != "")), "base", "n")
    return rules.select("repo", "base", F.regexp_replace("body", "^/+", "").alias("pattern"), (F.instr("body", "/") > 0).alias("anchored"), "negated", "dir_only", order.alias("ord"))


def _glob_regex(patterns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in patterns:
        yield pa.array([None if p.as_py() is None else "^" + fnmatch.translate(p.as_py()).replace("\\Z", "\\z") for p in column], pa.string())


def _ways(path: Column) -> Column:
    """array<struct<base, below>> of a path: every directory above it ('' first), and the parts of the path below that."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("base"), F.slice(parts, i + 1, F.size(parts)).alias("below")))


def _stretches(below: Column) -> Column:
    """array<struct<text, kind>> of what a rule without wildcards may equal: each part (``name``, the file's own as ``file``), each stretch of
    directories (``dir``) and each end of the path (``end``)."""
    n = F.size(below)
    at = F.sequence(F.lit(1), n)
    names = F.transform(at, lambda i: F.struct(F.element_at(below, i).alias("text"), F.when(i == n, "file").otherwise("name").alias("kind")))
    ends = F.transform(at, lambda i: F.struct(F.array_join(F.slice(below, i, n), "/").alias("text"), F.lit("end").alias("kind")))
    dirs = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: (j >= i) & (j < n)), lambda j: F.struct(F.array_join(F.slice(below, i, j - i + 1), "/").alias("text"), F.lit("dir").alias("kind")))))
    return F.array_distinct(F.concat(names, ends, dirs))


def _piece(head: Column, tail: Column, inner: Column) -> Column:
    return F.named_struct(F.lit("head"), head, F.lit("tail"), tail, F.lit("inner"), inner)


def _wild_keys(pattern: Column) -> Column:
    """struct<head, tail, inner>: literal texts that begin, end and lie within whatever a rule with wildcards fits. ``inner`` is '' where head and tail
    together are as long."""
    head, tail = F.regexp_extract(pattern, r"^([^*?\[]*)", 1), F.regexp_extract(pattern, r"([^*?\[\]]*)$", 1)
    pieces = F.split(F.regexp_replace(pattern, r"\[!?\]?[^\]]*\]", "*"), r"[*?\[\]]")
    longest = F.element_at(F.array_sort(F.transform(pieces, lambda x: F.named_struct(F.lit("n"), -F.length(x), F.lit("text"), x))), 1)["text"]
    by_ends = F.length(head) + F.length(tail) >= F.length(longest)
    return _piece(F.when(by_ends, head).otherwise(""), F.when(by_ends, tail).otherwise(""), F.when(by_ends, "").otherwise(longest))


def apply_gitignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``files`` (repo, path, ...) that the last matching rule of their repository does not ignore.

    A rule without '/' is tried on the file's name and on each part of its path; one with '/' on the path below the rule's directory, and
    behind any directories. A rule that ends in '/' holds for directories: it is tried on each directory above the file.

    Rules without wildcards are met by equality: every path brings, for each directory above it, the texts that such a rule may have, and these are
    joined on (repo, base, text). Of the others, '*' and a plain ending without '/' goes by equality of the last character run from its dot on. The rest
    is met by equality of literal pieces: the begin and end of a text, of the lengths that rules of its directory have, or, for rules whose longest
    piece lies between wildcards, all stretches of that length; only pairs of equal pieces are tried. Rules without any literal character are tried on all.
    """
    rules = cut(rules)
    literal = ~F.col("pattern").rlike(r"[*?\[]")
    kind = F.when(F.col("dir_only") & F.col("anchored"), F.array(F.lit("dir"))).when(F.col("dir_only"), F.array(F.lit("name"))).when(F.col("anchored"), F.array(F.lit("end"))).otherwise(F.array(F.lit("name"), F.lit("file")))
    plain = rules.where(literal).select("repo", "base", F.col("pattern").alias("text"), F.explode(kind).alias("kind"), "negated", "ord")
    by_suffix = ~F.col("anchored") & F.col("pattern").rlike(r"^\*\.[^*?\[./]+$")
    suffixed = rules.where(by_suffix).select("repo", "base", F.expr("substring(pattern, 2)").alias("text"), F.explode(F.when(F.col("dir_only"), F.array(F.lit("name"))).otherwise(F.array(F.lit("name"), F.lit("file")))).alias("kind"), "negated", "ord")
    regex = F.arrow_udf(_glob_regex, "string")
    wild = rules.where(~literal & ~by_suffix).select("repo", "base", F.explode(kind).alias("kind"), regex(F.col("pattern")).alias("glob"), "negated", "ord", F.inline(F.array(_wild_keys(F.col("pattern")))))
    lengths = [F.length(x).alias(x) for x in ("head", "tail", "inner")]
    wild = cut(wild.withColumn("shape", F.struct("kind", *lengths)))

    ways = files.select("repo", "path").select("repo", "path", F.inline(_ways(F.col("path"))))
    shapes = wild.groupBy("repo", "base").agg(F.collect_set("shape").alias("shapes"))
    bases = small(cut(rules.select("repo", "base").distinct().join(shapes, ["repo", "base"], "left")), 256)
    based = ways.join(bases, ["repo", "base"])
    stretches = based.select("repo", "path", "base", "shapes", F.inline(_stretches(F.col("below"))))
    met = stretches.join(plain, ["repo", "base", "text", "kind"]).select("repo", "path", "negated", "ord")
    ends = F.transform(F.sequence(F.lit(1), F.size("below")), lambda i: F.struct(F.regexp_extract(F.element_at("below", i), r"(\.[^.]*)$", 1).alias("text"), F.when(i == F.size("below"), "file").otherwise("name").alias("kind")))
    met = met.unionByName(based.select("repo", "path", "base", F.inline(F.array_distinct(ends))).join(suffixed, ["repo", "base", "text", "kind"]).select("repo", "path", "negated", "ord"))

    text, shape, n = F.col("text"), F.col("shape"), F.length("text")
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), n - shape["inner"] + 1), lambda i: _piece(F.lit(""), F.lit(""), F.substring(text, i, shape["inner"]))))
    around = F.array(_piece(F.left(text, shape["head"]), F.right(text, shape["tail"]), F.lit("")))
    fitting = stretches.select("repo", "path", "base", "text", "kind", F.explode("shapes").alias("shape")).where((shape["kind"] == F.col("kind")) & (n >= F.greatest(shape["head"], shape["tail"], shape["inner"])))
    tried = fitting.select("repo", "path", "base", "text", "shape", F.inline(F.when(shape["inner"] > 0, pieces).otherwise(around)))
    pairs = tried.join(wild.select("repo", "base", "shape", "head", "tail", "inner", "glob", "negated", "ord"), ["repo", "base", "shape", "head", "tail", "inner"])
    met = met.unionByName(pairs.where(F.regexp_like("text", F.col("glob"))).select("repo", "path", "negated", "ord"))
    ignored = met.groupBy("repo", "path").agg(F.max_by("negated", "ord").alias("negated")).where("NOT negated").select("repo", "path")
    return files.join(ignored, ["repo", "path"], "left_anti")


def discover(raw: DataFrame, limits: Limits = Limits(), gitignore: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of (repo, path, content binary, bytes, symlink boolean).

    In order: symbolic links are reported even in ignored directories; ignored and other files go silently; too large and binary files
    are reported; of more than ``limits.files`` the rest is cut off in path order and reported once per repository as '*'. Paths are unique in a
    repository. Contents are read where they lie: only paths are shuffled.
    """
    links = raw.where("symlink").select("repo", "path", F.lit("symlink").alias("reason"))
    plain = raw.where("NOT symlink").where(~in_ignored_dir(F.col("path")))
    if gitignore:
        plain = apply_gitignore(plain, gitignore_rules(plain))
    wanted = plain.where(is_candidate(F.col("path"))).withColumn("reason", F.when(F.col("bytes") > limits.file_bytes, "file_size_limit").when(is_binary(F.col("content")), "binary"))
    good = wanted.where("reason IS NULL")
    crowded = small(cut(good.groupBy("repo").count().where(F.col("count") > limits.files).select("repo")), 64)
    # Only repositories with too many files are numbered, by their paths alone; the first path beyond the limit is joined back.
    numbered = running_total(good.join(crowded, "repo", "left_semi").select("repo", "path", F.lit(1).cast("long").alias("one")), "repo", ["path"], "one", "n")
    ends = small(cut(numbered.where(F.col("n") == limits.files + 1).select("repo", F.col("path").alias("end"))), 256)
    files = good.join(ends, "repo", "left").where(F.col("end").isNull() | (F.col("path") < F.col("end"))).select("repo", "path", decoded(F.col("content")).alias("content"), "bytes")
    over = crowded.select("repo", F.lit("*").alias("path"), F.lit("file_count_limit").alias("reason"))
    return files, links.unionByName(wanted.where("reason IS NOT NULL").select("repo", "path", "reason")).unionByName(over)


def read_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, content, bytes, symlink) of all files below a folder.

    Links do not exist in shared stores; in a local folder they are listed by the driver, reported as links, and what they point to is not read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    inside = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    out = found.select(F.lit(repo).alias("repo"), inside.alias("path"), "content", F.col("length").alias("bytes"), F.lit(False).alias("symlink"))
    local = root.removeprefix("file://") if root.startswith(("file:///", "/")) else ""
    links = [os.path.relpath(os.path.join(d, n), local) for d, dirs, names in os.walk(local) for n in dirs + names if os.path.islink(os.path.join(d, n))] if os.path.isdir(local) else []
    if not links:
        return out
    found_links = spark.createDataFrame([(repo, p, None, 0, True) for p in links], out.schema)
    below = found_links.select(F.col("path").alias("link"))
    out = out.join(F.broadcast(below), (F.col("path") == F.col("link")) | F.col("path").startswith(F.concat("link", F.lit("/"))), "left_anti")
    return out.unionByName(found_links)


def load(spark: SparkSession, source: str, repo: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """(repo, path, content, bytes, symlink) of a source: an archive (*.zip), or a folder. An address of a host has to be fetched beforehand.

    The repository's name is that of the source's last part unless one is given.
    """
    name = repo or re.sub(r"\.zip$", "", source.rstrip("/").rsplit("/", 1)[-1], flags=re.I)
    if re.match(HOST_URL, source):
        raise ValueError("INVALID_SOURCE: fetch the archive and load its path")
    if source.lower().endswith(".zip"):
        return read_zip(spark.read.format("binaryFile").load(source).select(F.lit(name).alias("repo"), "content"), limits)
    return read_tree(spark, source, name)


def with_samples(requests: DataFrame, samples: DataFrame) -> DataFrame:
    """Requests (url, ...) with artifact: that of the stored sample (url, artifact) for the same repository, however its address is written."""
    def key(df: DataFrame) -> DataFrame:
        u = parse_repository_url(F.col("url"))
        return df.withColumn("__key", F.lower(F.concat_ws("/", u["owner"], u["repo"])))

    return key(requests).join(key(samples).groupBy("__key").agg(F.min("artifact").alias("artifact")), "__key", "left").drop("__key")


def unsafe_entry(path: Column) -> Column:
    """Names that would leave the archive's folder: absolute, with a drive, with '..' or a NUL."""
    return path.startswith("/") | path.rlike("^[A-Za-z]:") | path.contains("\0") | F.array_contains(F.split(path, "/"), "..")


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for repo, data, most, total in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                if sum(e.file_size for e in z.infolist() if e.file_size <= most) > total:
                    raise ValueError("EXTRACTED_TOO_LARGE")
                for e in z.infolist():
                    if not e.is_dir():
                        link = (e.external_attr >> 28) == 0xA
                        body = z.read(e) if e.file_size <= most and not link else b""  # larger entries are reported by their size
                        yield pa.RecordBatch.from_arrays([pa.array([repo]), pa.array([e.filename]), pa.array([body], pa.binary()), pa.array([e.file_size], pa.int64()), pa.array([link])], names=["repo", "path", "content", "bytes", "symlink"])


def read_zip(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(repo, path, content, bytes, symlink) of the entries of archives (repo, content). Fails on too large archives and unsafe names.

    Archives are opened in memory, one at a time in a task. A single top folder is taken off; '\\' in names becomes '/'.
    """
    size = F.octet_length("content")
    ok = archives.select("repo", F.when(size <= limits.archive_bytes, F.col("content")).otherwise(F.raise_error(F.lit("ARCHIVE_TOO_LARGE"))).alias("content"), F.lit(limits.file_bytes).alias("most"), F.lit(limits.extracted_bytes).alias("total"))
    rows = ok.mapInArrow(_unzip, "repo string, path string, content binary, bytes long, symlink boolean").withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    rows = rows.withColumn("path", F.when(unsafe_entry(F.col("path")), F.raise_error(F.lit("PATH_TRAVERSAL_DETECTED"))).otherwise(F.col("path")))
    tops = rows.groupBy("repo").agg(F.count_distinct(F.substring_index("path", "/", 1)).alias("tops"), F.min(F.instr("path", "/")).alias("slash"))
    single = (F.col("tops") == 1) & (F.col("slash") > 0)
    return rows.join(tops, "repo").withColumn("path", F.when(single, F.expr("substring(path, instr(path, '/') + 1)")).otherwise(F.col("path"))).drop("tops", "slash")


def cumulative_cap(files: DataFrame, limit: int) -> DataFrame:
    """(repo, path, file_ord, bytes) of ``files`` with total (bytes of this and earlier files) and within (total <= limit). No content is read."""
    narrow = files.select("repo", "path", "file_ord", "bytes")
    return running_total(narrow, "repo", ["file_ord", "path"], "bytes").withColumn("within", F.col("total") <= limit)


def capped(files: DataFrame, limit: int) -> DataFrame:
    """Rows of ``files`` (repo, path, file_ord, bytes, content, ...) whose running total stays within ``limit``.

    Repositories within the limit as a whole need no total of their own; for each of the others the first row beyond it is found on narrow
    rows and joined back. There are at most (all bytes / limit) of those, and contents move only if even they are too many to broadcast.
    """
    whole = files.groupBy("repo").agg(F.sum("bytes").alias("all")).where(F.col("all") > limit)
    if not (over := small(cut(whole.select("repo")), 64)).limit(1).count():
        return files
    first = cumulative_cap(files.join(over, "repo", "left_semi"), limit).where("NOT within").groupBy("repo").agg(F.min(F.struct("file_ord", "path")).alias("end"))
    return files.join(small(cut(first), 256), "repo", "left").where(F.col("end").isNull() | (F.struct("file_ord", "path") < F.col("end"))).drop("end")


def upload_names(path: Column) -> tuple[Column, Column]:
    """(repository name, path within it) of an uploaded file: the first part names the repository."""
    parts = F.split(path, "/")
    many = F.size(parts) > 1
    return F.when(many, parts[0]).otherwise("local-repository"), F.when(many, F.array_join(F.slice(parts, 2, F.size(parts)), "/")).otherwise(path)


# Forms of a repository address.
HOST_URL = r"^https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
SHORT_NAME = r"^([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)$"


def parse_repository_url(url: Column) -> Column:
    """struct<owner, repo> of a repository address (https or http, with or without 'www.' and '.git') or of owner/repo; null if it is neither."""
    u = F.trim(url)
    pair = lambda p: F.struct(F.regexp_extract(u, p, 1).alias("owner"), F.regexp_extract(u, p, 2).alias("repo"))
    return F.when(u.rlike(HOST_URL), pair(HOST_URL)).when(u.rlike(SHORT_NAME), pair(SHORT_NAME))


def fetch_error(status: Column) -> Column:
    """Error code of a failed fetch by HTTP status."""
    return F.when(status == 401, "UNAUTHORIZED").when(status == 403, "FORBIDDEN").when(status == 404, "NOT_FOUND").when(status == 429, "RATE_LIMITED").when(status >= 400, "UPSTREAM_ERROR")


def listing_page(repos: DataFrame, query: str, page: int, size: int = 15) -> DataFrame:
    """A page of (name, full_name, description, updated_at, ...) whose texts contain the query, latest first; has_more tells of a next page."""
    q = query.lower()
    found = repos.where(F.lower("name").contains(q) | F.lower("full_name").contains(q) | F.lower(F.coalesce("description", F.lit(""))).contains(q)) if q else repos
    rows = found.orderBy(F.desc("updated_at"), "full_name").offset((page - 1) * size).limit(size + 1)
    n = F.row_number().over(W.orderBy(F.desc("updated_at"), "full_name"))
    total = F.count("*").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("n", n).withColumn("has_more", total > size).where(F.col("n") <= size)
