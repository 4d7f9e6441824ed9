"""Package facts of manifests beyond the plain ones, build files above a project, database routines, and usage logs and feeds."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import python_name
from ..operators.latest import latest_per_key
from ..operators.store import cut
from . import documents

# Packages


def package_facts(*facts: tuple[str, DataFrame]) -> DataFrame:
    """(ecosystem, path, name, version, pinned) of all parsers' packages in one table, each once. facts: (ecosystem, table with path,
    name or coordinate, and version and pinned or none). Where a table doesn't tell, a literal version is a pin and a range is none."""
    out = None
    for ecosystem, df in facts:
        name = "coordinate" if "coordinate" in df.columns else "name"
        version = F.col("version") if "version" in df.columns else F.lit(None).cast("string")
        pinned = F.col("pinned") if "pinned" in df.columns else version.rlike(r"^[vV=]*[0-9][^\s,*$\[\]()<>^~|]*$")
        one = df.select(F.lit(ecosystem).alias("ecosystem"), "path", F.col(name).alias("name"), version.alias("version"), F.coalesce(pinned, F.lit(False)).alias("pinned"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


_LOCKFILE = r"(^|/)package-lock\.json$"
_FLAT_NAME, _ALIAS = re.compile(r"node_modules/((?:@[^/]+/)?[^/]+)$"), re.compile(r"npm:(.+)@([^@]*)$")


def _locked(content: str | None) -> Iterator[tuple[str, str, bool]]:
    """(name, version, dev) of a lockfile's entries: of its packages map, and where that tells nothing of its dependencies and of all
    that is nested in them. An alias gives the package that it stands for. Objects come as tuples of pairs, so that a repeated key
    keeps its entries, and numbers as they are written. Text that is no JSON, or nested too deep for the parser, has none."""
    try:
        root = json.loads(content or "", object_pairs_hook=tuple, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return
    pairs = lambda holder, name: x if isinstance(holder, tuple) and isinstance(x := dict(holder).get(name), tuple) else ()
    told = False
    for key, entry in pairs(root, "packages"):
        said = dict(entry) if isinstance(entry, tuple) else {}
        if key and isinstance(said.get("version"), str):
            told, name = True, said.get("name")
            yield name if isinstance(name, str) else m[1] if (m := _FLAT_NAME.search(key)) else "", said["version"], said.get("dev") is True
    left = [] if told else [pairs(root, "dependencies")]
    while left:
        for key, entry in left.pop():
            said = dict(entry) if isinstance(entry, tuple) else {}
            version = said.get("version")
            if isinstance(version, str):
                alias = _ALIAS.match(version)
                yield *(alias.groups() if alias else (key, version)), said.get("dev") in (True, "true")
            if isinstance(said.get("dependencies"), tuple):
                left.append(said["dependencies"])


def _lock_rows(files: DataFrame) -> DataFrame:
    """(path, name, version, is_dev) of lockfiles. Each is parsed and walked once, in batches of files, so the work grows with the text,
    however deep it nests. A file must fit into Arrow's two GB of text."""
    # Half of a broken surrogate pair, which UTF-8 can't hold, becomes a question mark.
    plain = lambda t: t if t.isascii() else t.encode("utf-8", "replace").decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *x) for i, content in enumerate(b.column("content").to_pylist()) for x in _locked(content)]
            at, name, version, dev = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column("path").take(pa.array(at, pa.int64())), pa.array(map(plain, name), pa.string()), pa.array(map(plain, version), pa.string()), pa.array(dev, pa.bool_())], ["path", "name", "version", "dev"])

    rows = files.select("path", "content").mapInArrow(run, "path string, name string, version string, dev boolean")
    return rows.groupBy("path", F.lower("name").alias("name"), "version").agg(F.bool_and("dev").alias("is_dev"))


def npm_lock_v1(files: DataFrame) -> DataFrame:
    """(path, name, version, is_dev) of lockfiles without a packages map: their dependencies at every depth. A package of several uses
    counts as dev only if all are."""
    return _lock_rows(files.filter(F.col("path").rlike(_LOCKFILE) & F.get_json_object("content", "$.packages").isNull()))


def npm_packages(files: DataFrame) -> DataFrame:
    """(path, name, version, is_dev) of lockfiles of any version: those of the packages map, and where it tells nothing the nested
    dependencies. Files that are no JSON have none."""
    return _lock_rows(files.filter(F.col("path").rlike(_LOCKFILE)))


_SPEC = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:(===?|>=|~=|<=|>|<|!=|\^)?\s*([0-9][^,;\s\"']*))?"


def _python(rows: DataFrame, spec: Column) -> DataFrame:
    """(path, name, version, pinned): only == and === pin."""
    part = lambda i: F.regexp_extract(spec, _SPEC, i)
    out = rows.select("path", python_name(part(1)).alias("name"), F.nullif(part(3), F.lit("")).alias("version"), (part(2).isin("==", "===") & ~part(3).contains("*")).alias("pinned"))
    return out.filter("name <> '' and name <> 'python'")


def pyproject_dependencies(files: DataFrame) -> DataFrame:
    """(path, name, version, pinned) of pyproject.toml: project.dependencies, and the tables of dependencies of a tool."""
    f = files.filter(F.col("path").rlike(r"(^|/)pyproject\.toml$"))
    listed = F.regexp_extract("content", r"(?ms)^\[project\].*?^dependencies\s*=\s*\[(.*?)^?\]\s*$", 1)
    pep = _python(f.select("path", F.explode(F.regexp_extract_all(listed, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))).alias("s")), F.col("s"))
    return pep.unionByName(_table(f, r"tool\.poetry(?:\.group\.[^.\]]+)?\.(?:dev-)?dependencies"))


def pipfile_dependencies(files: DataFrame) -> DataFrame:
    return _table(files.filter(F.col("path").rlike(r"(^|/)Pipfile$")), r"(?:dev-)?packages")


def setup_dependencies(files: DataFrame) -> DataFrame:
    """(path, name, version, pinned) of install_requires in setup.py and setup.cfg."""
    f = files.filter(F.col("path").rlike(r"(^|/)setup\.(py|cfg)$"))
    quoted = F.regexp_extract_all(F.regexp_extract("content", r"(?s)install_requires\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))
    plain = F.filter(F.transform(F.split(F.regexp_extract("content", r"(?m)^install_requires\s*=\s*\n((?:[ \t]+\S.*\n?)+)", 1), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return _python(f.select("path", F.explode(F.concat(quoted, plain)).alias("s")), F.col("s"))


def _table(files: DataFrame, header: str) -> DataFrame:
    """Lines `name = "version"` or `name = {version = "..."}` below a header."""
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "l"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("l").startswith("["), F.col("l")), ignorenulls=True).over(w)
    rows = rows.withColumn("s", section).filter(F.col("s").rlike(rf"^\[{header}\]")).filter(F.col("l").rlike(r"^[A-Za-z0-9\"]") & F.col("l").contains("="))
    name = python_name(F.regexp_replace(F.regexp_extract("l", r"^\"?([A-Za-z0-9._-]+)", 1), "\"", ""))
    value = r"=\s*(?:\{.*?version\s*=\s*)?[\"']\s*([\^~=<>!]*)\s*v?([0-9][^,\"']*)(,?)"
    part = lambda i: F.regexp_extract("l", value, i)
    pinned = (part(2) != "") & part(1).isin("", "=", "==", "===") & ~part(2).contains("*") & (part(3) == "")
    return rows.select("path", name.alias("name"), F.nullif(part(2), F.lit("")).alias("version"), pinned.alias("pinned")).filter("name <> 'python'")


# Build files


def _folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def _ancestors(folder: Column) -> Column:
    """A folder and all above it, '' at last."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def nearest_ancestor(projects: DataFrame, props: DataFrame, *columns: str) -> DataFrame:
    """projects (path, ...) with the columns of the props file (path, ...) in their own folder or the closest one above it;
    null where there is none. Folders meet as equal keys, after each project lists its ancestors."""
    up = projects.select("path", F.explode(_ancestors(_folder(F.lower("path")))).alias("_dir"))
    at = props.select(_folder(F.lower("path")).alias("_dir"), F.struct(*columns).alias("_row"))
    best = up.join(at, "_dir").groupBy("path").agg(F.max_by("_row", F.length("_dir")).alias("_row"))
    return projects.join(best, "path", "left").select(*projects.columns, *[F.col(f"_row.{c}").alias(c) for c in columns])


def project_packages(files: DataFrame) -> DataFrame:
    """(path, name, version) of project files; a reference without a version takes that of the closest Directory.Packages.props,
    and a version $(Name) takes the value of that property in the closest Directory.Build.props."""
    p = files.filter(F.col("path").rlike(r"(?i)\.(csproj|vbproj|fsproj)$"))
    refs = p.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<PackageReference\s[^>]*?(?:/>|>.*?</PackageReference>)"), F.lit(0))).alias("r"))
    version = F.coalesce(*[F.nullif(F.regexp_extract("r", x, 1), F.lit("")) for x in (r'VersionOverride="([^"]+)"', r'\sVersion="([^"]+)"', r"<Version>([^<]+)</Version>")])
    refs = refs.select("path", F.regexp_extract("r", r'(?:Include|Update)="([^"]+)"', 1).alias("name"), version.alias("version")).filter("name <> ''")
    pairs = lambda pattern: F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)), F.regexp_extract(x, pattern, 2)))
    as_map = lambda a: F.map_from_entries(F.aggregate(a, F.array().cast("array<struct<_1:string,_2:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["_1"] == x["col1"]), acc).otherwise(F.concat(acc, F.array(F.struct(x["col1"].alias("_1"), x["col2"].alias("_2")))))))
    central = files.filter(F.col("path").rlike(r"(?i)(^|/)Directory\.Packages\.props$")).select("path", as_map(pairs(r'<PackageVersion\s+[^>]*?Include="([^"]+)"[^>]*?\sVersion="([^"]+)"')).alias("central"))
    build = files.filter(F.col("path").rlike(r"(?i)(^|/)Directory\.Build\.props$")).select("path", as_map(pairs(r"<([A-Za-z_][\w.]*)>([^<]*)</")).alias("properties"))
    known = nearest_ancestor(nearest_ancestor(p.select("path"), central, "central"), build, "properties")
    df = refs.join(known, "path", "left").withColumn("v", F.coalesce("version", F.try_element_at("central", F.lower("name"))))
    name = F.lower(F.regexp_extract("v", r"^\$\(([\w.]+)\)$", 1))
    return df.select("path", "name", F.when(name != "", F.try_element_at("properties", name)).otherwise(F.col("v")).alias("version"))


def project_references(projects: DataFrame) -> DataFrame:
    """(src, dst, resolved) of projects (path, references): relative paths become paths of the workspace, without . and ..; one
    that no project has stays as it is, unresolved."""
    refs = projects.select("path", F.explode("references").alias("ref"))
    joined = F.concat_ws("/", F.nullif(_folder(F.col("path")), F.lit("")), F.replace("ref", F.lit("\\"), F.lit("/")))
    none = F.array().cast("array<string>")
    walked = F.aggregate(F.split(joined, "/"), none, lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    target = refs.select(F.col("path").alias("src"), F.array_join(walked, "/").alias("target"))
    known = projects.select(F.lower("path").alias("_key"), F.col("path").alias("_known"))
    out = target.join(known, F.lower("target") == F.col("_key"), "left")
    return out.select("src", F.coalesce("_known", "target").alias("dst"), F.col("_known").isNotNull().alias("resolved"))


def known_servers(servers: DataFrame, known: DataFrame) -> DataFrame:
    """servers (server, command, url, and args where there are any) with the columns of the known server (match, known, ...) whose match is
    the longest in any of them; null where none is."""
    said = ["server", "command", "url", *(["args"] if "args" in servers.columns else [])]
    text = F.lower(F.concat_ws(" ", *said))
    told = [c for c in known.columns if c != "match"]
    texts = servers.select(text.alias("_text")).distinct()
    best = texts.join(known, F.contains("_text", F.lower("match"))).groupBy("_text").agg(F.max_by(F.struct(*told), F.struct(F.length("match"), "match")).alias("_known"))
    return servers.withColumn("_text", text).join(best, "_text", "left").select(*servers.columns, *[F.col(f"_known.{c}").alias(c) for c in told])


# Databases

# Kinds of routines, words that add a branch, words that begin a statement, and how many characters behind a call
# that executes text are read.
_ROUTINES = {"PROCEDURE": "procedure", "PROC": "procedure", "FUNCTION": "function", "TRIGGER": "trigger"}
_BRANCHES = {"IF", "WHILE", "CASE", "WHEN", "ELSIF", "ELSEIF", "LOOP"}
_STATEMENTS = {"SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "SET", "EXEC", "EXECUTE", "RETURN", "RAISERROR", "THROW", "BEGIN", "COMMIT", "ROLLBACK"}
_REACH = 400
# A token: a comment, a string, a quoted name, a word or variable, two signs that belong together, or one.
_TOKEN = re.compile(r"(?s)(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'[^']*')|(?P<word>\[[^\]\n]*\]|\"[^\"\n]*\"|@{0,2}\w[\w$#]*)|(?P<sign>\|\||\+=|[^\s\w])")


class _Sql:
    """The tokens of a script without its comments: spelt as they stand, in upper case, where they begin, and their line."""

    def __init__(self, sql: str):
        found = [m for m in _TOKEN.finditer(sql) if m.lastgroup != "comment"]
        self.text = [m[0] for m in found]
        self.up = [m[0].upper() if m.lastgroup != "text" else "''" for m in found]
        self.at = [m.start() for m in found]
        breaks = [i for i, c in enumerate(sql) if c == "\n"]
        self.line = [bisect_left(breaks, p) for p in self.at]
        self.size = len(found)

    def leads(self, i: int) -> bool:
        """Whether a token is the first of its line."""
        return i == 0 or self.line[i - 1] < self.line[i]

    def heads(self) -> Iterator[tuple[int, int, int]]:
        """(CREATE, kind, end of the name) of each routine's beginning."""
        for i in range(self.size):
            if self.up[i] != "CREATE" or not self.leads(i):
                continue
            kind = i + 1
            if self.up[kind : kind + 1] == ["OR"] and self.up[kind + 1 : kind + 2] in (["ALTER"], ["REPLACE"]):
                kind += 2
            if kind + 1 < self.size and self.up[kind] in _ROUTINES:
                end = kind + 2
                while end + 1 < self.size and self.up[end] == ".":
                    end += 2
                yield i, kind, end

    def batch_end(self, lo: int, hi: int) -> int:
        """The first GO that has its line for itself, or hi."""
        for i in range(lo, hi):
            alone = i + 1 >= self.size or self.leads(i + 1) or (self.up[i + 1] == ";" and (i + 2 >= self.size or self.leads(i + 2)))
            if self.up[i] == "GO" and self.leads(i) and alone:
                return i
        return hi

    def cursors(self, lo: int, hi: int) -> int:
        """DECLARE name ... CURSOR, and CURSOR name IS or FOR."""
        n = 0
        for i in range(lo, hi):
            if self.up[i] == "DECLARE":
                j = i + 2
                while j < hi and self.up[j] in ("INSENSITIVE", "SCROLL"):
                    j += 1
                n += j < hi and self.up[j] == "CURSOR"
            elif self.up[i] == "CURSOR" and i + 2 < hi and self.up[i + 2] in ("IS", "FOR"):
                n += 1
        return n

    def is_dynamic(self, lo: int, hi: int) -> bool:
        """Text is put together where it is executed, or in an assignment to the variable that is executed."""
        joins = lambda part: any(t in ("+", "||", "+=", "CONCAT") for t in part)
        same_line = lambda i, j: next((k for k in range(i, j) if self.line[k] > self.line[i - 1]), j)
        built: set[str] = set()
        for i in range(lo, hi - 2):
            name, j = self.up[i + 1], i + 2
            if self.up[i] == "DECLARE" and name.startswith("@"):
                # The sign may stand behind the type, before the statement or the line ends.
                j = next((k for k in range(j, same_line(j, hi)) if self.up[k] in ("=", ";")), hi)
            elif self.up[i] not in ("SET", "SELECT") or not name.startswith("@"):
                continue
            if j < hi and (self.up[j] == "+=" or self.up[j] == "=" and joins(self.up[j + 1 : same_line(j + 1, hi)])):
                built.add(name)
        for i in range(lo, hi):
            call = self.up[i] in ("EXEC", "EXECUTE") and self.up[i + 1 : min(i + 2, hi)] in (["("], ["IMMEDIATE"])
            if not call and self.up[i] != "SP_EXECUTESQL":
                continue
            first = i + 2 if call else i + 1
            end = next((k for k in range(first, same_line(first, hi)) if self.up[k] == ";" or self.at[k] > self.at[first - 1] + _REACH), same_line(first, hi)) if first < hi else hi
            part = self.up[first:end]
            if joins(part) or next((v for v in part if v.startswith("@")), None) in built:
                return True
        return False


def sql_routines(files: DataFrame) -> DataFrame:
    """(path, kind, name, line, end_line, complexity, cursors, statements, select_all, dynamic_sql) of routines in SQL files.

    A routine ends before the next one or at its batch's GO. Comments and what stands in strings count for nothing. Files are read
    as tokens, one at a time, in batches of files; a file must fit into Arrow's two GB of text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, sql in zip(b["path"], b["content"]):
                t = _Sql(sql or "")
                heads = list(t.heads())
                for (lo, kind, end), after in zip(heads, [*(h[0] for h in heads[1:]), t.size]):
                    hi = t.batch_end(lo, after)
                    up = t.up[lo:hi]
                    name = re.sub(r"[\[\]\"]", "", "".join(t.text[kind + 1 : end]))
                    everything = any(x == "SELECT" and y == "*" for x, y in zip(up, up[1:]))
                    rows.append((path, _ROUTINES[t.up[kind]], name, t.line[kind] + 1, t.line[hi - 1] + 1, 1 + sum(x in _BRANCHES for x in up), t.cursors(lo, hi), sum(x in _STATEMENTS for x in up), everything, t.is_dynamic(lo, hi)))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "end_line", "complexity", "cursors", "statements", "select_all", "dynamic_sql"])

    schema = "path string, kind string, name string, line int, end_line int, complexity int, cursors int, statements int, select_all boolean, dynamic_sql boolean"
    return files.filter(F.lower("path").endswith(".sql")).select("path", "content").mapInPandas(run, schema)


def sql_cursors(files: DataFrame) -> DataFrame:
    """(path, cursors) of the SQL files that declare any, in routines or outside them; comments and strings count for nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scripts = [_Sql(sql or "") for sql in b["content"]]
            yield pd.DataFrame({"path": b["path"], "cursors": [t.cursors(0, t.size) for t in scripts]})

    found = files.filter(F.lower("path").endswith(".sql")).select("path", "content").mapInPandas(run, "path string, cursors int")
    return found.filter("cursors > 0")


def coverage_reports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (path, line_rate) and packages (path, package, line_rate) of Cobertura and OpenCover files; a module of the latter
    is a package, and rates are shares of visited points."""
    c = files.filter(F.col("content").rlike(r"<coverage\s[^>]*line-rate="))
    rate = F.regexp_extract("content", r"<coverage\s[^>]*?line-rate=\"([^\"]+)\"", 1).try_cast("double")
    o = files.filter(F.col("content").contains("<CoverageSession"))
    share = lambda text: F.try_divide(F.regexp_extract(text, r"<Summary[^>]*?visitedSequencePoints=\"(\d+)\"", 1).try_cast("double"), F.regexp_extract(text, r"<Summary[^>]*?numSequencePoints=\"(\d+)\"", 1).try_cast("double"))
    reports = c.select("path", rate.alias("line_rate")).unionByName(o.select("path", share(F.col("content")).alias("line_rate"))).filter("line_rate between 0 and 1")
    modules = o.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<Module[\s>](?:(?!skippedDueTo).)*?</Module>"), F.lit(0))).alias("m"))
    packages = modules.select("path", F.regexp_extract("m", r"<ModuleName>([^<]*)</ModuleName>", 1).alias("package"), share(F.col("m")).alias("line_rate")).filter("line_rate between 0 and 1 and package <> ''")
    return reports, documents.coverage_packages(files).unionByName(packages)


# Usage


def rollout_usage(lines: DataFrame) -> DataFrame:
    """(day, model, input_tokens, output_tokens, cache_read_tokens, requests, sessions) of rollout logs: lines (path, n, text).

    A file's session and model hold from the line that names them on; until then the session is the file's name and the
    model unknown. Cached tokens are part of the input and are told apart. Lines that are no documents are passed over.
    """
    schema = "struct<type:string,timestamp:timestamp,payload:struct<id:string,model:string,type:string,info:struct<last_token_usage:struct<input_tokens:long,cached_input_tokens:long,output_tokens:long>>>>"
    j = F.from_json("text", schema)
    rows = lines.select("path", "n", j.alias("j")).filter("j.type is not null and j.payload is not null")
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    model = F.last(F.when((F.col("j.type") == "turn_context") & (F.trim("j.payload.model") != ""), F.col("j.payload.model")), ignorenulls=True).over(w)
    session = F.last(F.when(F.col("j.type") == "session_meta", F.col("j.payload.id")), ignorenulls=True).over(w)
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    rows = rows.withColumns({"model": F.coalesce(model, F.lit("unknown")), "session": F.coalesce(session, stem)})
    use = F.col("j.payload.info.last_token_usage")
    number = lambda c: F.coalesce(use[c], F.lit(0))
    rows = rows.filter((F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count") & use.isNotNull() & F.col("j.timestamp").isNotNull())
    rows = rows.select(F.to_date("j.timestamp").alias("day"), "model", "session", number("input_tokens").alias("i"), number("cached_input_tokens").alias("c"), number("output_tokens").alias("o")).filter("i + c + o <> 0")
    return rows.groupBy("day", "model").agg(F.sum(F.greatest(F.col("i") - F.col("c"), F.lit(0))).alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("c").alias("cache_read_tokens"), F.count(F.lit(1)).alias("requests"), F.countDistinct("session").alias("sessions"))


def analytics_by_day(records: DataFrame) -> DataFrame:
    """(day, model, actors, sessions, tokens, cost) of usage analytics: records (day, actor, sessions, models), models an array of
    (model, tokens, cents). Actors and sessions are those of the day, whatever the model."""
    per_day = records.groupBy("day").agg(F.countDistinct("actor").alias("actors"), F.sum("sessions").alias("sessions"))
    per = records.select("day", F.explode("models").alias("m")).groupBy("day", F.col("m.model").alias("model")).agg(F.sum("m.tokens").alias("tokens"), (F.sum("m.cents") / 100).cast("decimal(18,2)").alias("cost"))
    return per.join(per_day, "day").select("day", "model", "actors", "sessions", "tokens", "cost")


def seat_costs(seats: DataFrame, prices: DataFrame) -> DataFrame:
    """(plan, seats, monthly): seats (actor, plan) by list price (plan, price); a plan without a price costs null."""
    n = seats.groupBy(F.lower("plan").alias("plan")).agg(F.countDistinct("actor").alias("seats"))
    return n.join(prices.select(F.lower("plan").alias("plan"), "price"), "plan", "left").select("plan", "seats", (F.col("seats") * F.col("price")).alias("monthly"))


def event_usage(members: DataFrame, events: DataFrame) -> DataFrame:
    """(actor, day, model, tokens, cents, requests, last_activity) of usage events (actor, at, model, tokens, cents), with the name
    of each member; members without events are there with nulls and the rest of the table is left to their actors."""
    per = events.groupBy("actor", F.to_date("at").alias("day"), "model").agg(F.sum("tokens").alias("tokens"), F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("requests"), F.max("at").alias("last_activity"))
    return members.select("actor", "name").join(per, "actor", "full")


def renamed_paths(log: DataFrame) -> DataFrame:
    """(repo, path, alias) of renames in numstat lines (repo, n, text): every old path with the newest one it became, over any
    number of renames; the log runs from new to old, so a later rename of the same file stands above."""
    t = F.split("text", "\t")[2]
    braced = t.rlike(r"\{[^{}]* => [^{}]*\}")
    side = lambda k: F.regexp_replace(F.when(braced, F.regexp_replace(t, r"\{([^{}]*) => ([^{}]*)\}", f"${k}")).otherwise(F.regexp_extract(t, r"^(.*) => (.*)$", k)), "//", "/")
    moves = log.filter(F.col("text").rlike(r"^(\d+|-)\t(\d+|-)\t.* => ")).select("repo", side(1).alias("path"), side(2).alias("to"), "n")
    known = latest_per_key(moves, ["repo", "path"], [F.col("n")]).select("repo", "path", F.col("to").alias("alias"))
    for _ in range(40):  # paths double in length each round; a ring of renames never ends
        next_ = known.select("repo", F.col("path").alias("alias"), F.col("alias").alias("further"))
        longer = known.join(next_, ["repo", "alias"], "left").filter("further is not null and further <> path")
        if not longer.take(1):
            break
        known = cut(known.join(longer.select("repo", "path", "further"), ["repo", "path"], "left").select("repo", "path", F.coalesce("further", "alias").alias("alias")), "renames")
    return known

