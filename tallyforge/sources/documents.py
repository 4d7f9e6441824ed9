"""Parsers of structured documents: telemetry, SARIF, manifests, vulnerability bundles, histories, schemas, session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import author_key, is_bot, python_name, sarif_severity, slug

_ATTR = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_POINT = f"struct<attributes:{_ATTR},asInt:string,asDouble:double,sum:double,count:string,startTimeUnixNano:string,timeUnixNano:string>"
_SERIES = f"struct<aggregationTemporality:string,dataPoints:array<{_POINT}>>"
METRICS = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_ATTR}>,scopeMetrics:array<struct<metrics:array<struct<name:string,sum:{_SERIES},histogram:{_SERIES}>>>>>>>"
TRACES = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTR}>,scopeSpans:array<struct<spans:array<struct<name:string,startTimeUnixNano:string,attributes:{_ATTR}>>>>>>>"
# Counters of tokens and money that telemetry names.
TOKEN_METRICS = ["claude_code.token.usage", "gemini_cli.token.usage", "gen_ai.client.token.usage"]
COST_METRICS = ["claude_code.cost.usage"]


def _map(attributes: Column) -> Column:
    v = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string"))
    entries = F.transform(F.coalesce(attributes, F.array().cast(_ATTR)), lambda a: F.struct(a["key"], v(a)))
    return F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull()))


def _merge(a: Column, b: Column) -> Column:
    """b over a, whatever the session does with duplicate keys."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def otlp_points(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(metric, kind, attributes, stream_key, value, requests, cumulative, started, at) of the token and cost points in
    OTLP metric documents, one a row; anything else is skipped."""
    m = payloads.select(F.explode(F.from_json(column, METRICS)["resourceMetrics"]).alias("r"))
    m = m.select(_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeMetrics").alias("s")).select("resource", F.explode("s.metrics").alias("m"))
    name = F.col("m.name")
    kind = F.when(name.isin(TOKEN_METRICS), "tokens").when(name.isin(COST_METRICS), "cost")
    series = F.coalesce("m.sum", "m.histogram")
    m = m.select(name.alias("metric"), kind.alias("kind"), "resource", F.col("m.histogram").isNotNull().alias("h"), series["aggregationTemporality"].isin("2", "AGGREGATION_TEMPORALITY_CUMULATIVE").alias("cumulative"), F.explode(series["dataPoints"]).alias("p")).filter("kind is not null")
    own = _map(F.col("p.attributes"))
    ordered = lambda x: F.to_json(F.array_sort(F.map_entries(x)))
    value = F.when(F.col("h"), F.col("p.sum")).otherwise(F.coalesce(F.col("p.asDouble"), F.col("p.asInt").try_cast("double"), F.lit(0.0)))
    nanos = lambda c: F.timestamp_micros((F.col(c).try_cast("long") / 1000).cast("long"))
    return m.select("metric", "kind", _merge(F.col("resource"), own).alias("attributes"), F.sha2(F.concat_ws("\n", "metric", ordered(F.col("resource")), ordered(own)), 256).alias("stream_key"), F.coalesce(value, F.lit(0.0)).alias("value"), F.when(F.col("h"), F.col("p.count").try_cast("long")).alias("requests"), F.coalesce("cumulative", F.lit(False)).alias("cumulative"), F.coalesce(F.col("p.startTimeUnixNano").try_cast("long"), F.lit(0)).alias("started"), nanos("p.timeUnixNano").alias("at"))


def otlp_spans(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(at, model, provider, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, cost, session) of the spans that
    carry token counts."""
    s = payloads.select(F.explode(F.from_json(column, TRACES)["resourceSpans"]).alias("r"))
    s = s.select(_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("ss")).select("resource", F.explode("ss.spans").alias("s"))
    s = s.select(F.timestamp_micros((F.col("s.startTimeUnixNano").try_cast("long") / 1000).cast("long")).alias("at"), _merge(F.col("resource"), _map(F.col("s.attributes"))).alias("a"))
    get = lambda *names: F.coalesce(*[F.try_element_at("a", F.lit(n)) for n in names])
    n = lambda *names: get(*names).try_cast("long")
    out = s.select("at", F.coalesce(get("gen_ai.response.model", "gen_ai.request.model"), F.lit("unknown")).alias("model"), get("gen_ai.provider.name", "gen_ai.system").alias("provider"), n("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.usage.prompt_tokens").alias("i"), n("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.usage.completion_tokens").alias("o"), F.coalesce(n("gen_ai.usage.cache_read_input_tokens", "gen_ai.usage.cached_input_tokens"), F.lit(0)).alias("cache_read_tokens"), F.coalesce(n("gen_ai.usage.cache_creation_input_tokens"), F.lit(0)).alias("cache_write_tokens"), get("gen_ai.usage.cost", "gen_ai.usage.cost_usd").try_cast("double").alias("cost"), get("session.id").alias("session"))
    return out.filter("i is not null or o is not null").withColumns({"input_tokens": F.coalesce("i", F.lit(0)), "output_tokens": F.coalesce("o", F.lit(0))}).drop("i", "o")


SARIF = "struct<runs:array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,properties:map<string,string>>>>>,results:array<struct<ruleId:string,level:string,properties:map<string,string>,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>>"


def sarif_findings(documents: DataFrame, column: str = "content", prefix: str = "external") -> DataFrame:
    """(rule_id, severity, message, file_path, line_start, line_end, sarif_rule) of the first tool's runs of each SARIF document.

    A rule is known by the slug of its id. Where ids of one document share a slug, the first of them, by its place in the rules and then
    in the results, keeps it, and the others carry a hash of their id, so that they stay rules of their own. A score of a
    result outranks that of its rule, and both outrank the level.
    """
    d = documents.select(F.xxhash64(column).alias("log"), F.from_json(column, SARIF)["runs"].alias("runs")).withColumn("tool", F.get("runs", F.lit(0))["tool"]["driver"]["name"])
    runs = d.select("log", "tool", F.posexplode("runs").alias("n", "run")).filter(F.lower("run.tool.driver.name").eqNullSafe(F.lower("tool")))
    original = F.coalesce(F.nullif("f.ruleId", F.lit("")), F.lit("result"))
    told = runs.select("log", "tool", F.struct(F.lit(0).alias("kind"), "n", F.lit(0).alias("at")).alias("place"), F.explode("run.tool.driver.rules.id").alias("id")).filter("id is not null")
    results = runs.select("log", "tool", "n", "run", F.posexplode("run.results").alias("at", "f")).withColumn("id", original)
    seen = told.unionByName(results.select("log", "tool", F.struct(F.lit(1).alias("kind"), "n", "at").alias("place"), "id"))
    ids = seen.groupBy("log", "id").agg(F.min("place").alias("place")).withColumn("slug", slug(F.col("id")))
    owners = ids.groupBy("log", "slug").agg(F.min_by("id", F.struct("place", "id")).alias("owner"), F.count(F.lit(1)).alias("sharers")).filter("sharers > 1")
    apart = F.concat_ws("-", F.left("slug", F.lit(53)), F.left(F.sha2("id", 256), F.lit(6)))
    clashing = ids.join(owners, ["log", "slug"]).filter("id <> owner").select("log", "id", apart.alias("own_slug")).distinct()
    rules = F.filter(F.col("run.tool.driver.rules"), lambda x: x["id"].isNotNull())
    scores = F.map_from_entries(F.array_distinct(F.transform(rules, lambda x: F.struct(x["id"], F.try_element_at(x["properties"], F.lit("security-severity")).try_cast("double")))))
    own = F.try_element_at("f.properties", F.lit("security-severity")).try_cast("double")
    r = results.join(clashing, ["log", "id"], "left")
    loc = F.get("f.locations", F.lit(0))["physicalLocation"]
    return r.select(
        F.concat_ws(".", F.lit(prefix), slug(F.col("tool")), F.coalesce("own_slug", slug(F.col("id")))).alias("rule_id"),
        sarif_severity(F.coalesce(own, F.try_element_at(scores, F.col("f.ruleId"))), F.col("f.level")).alias("severity"),
        F.col("f.message.text").alias("message"),
        loc["artifactLocation"]["uri"].alias("file_path"),
        loc["region"]["startLine"].alias("line_start"),
        loc["region"]["endLine"].alias("line_end"),
        F.col("id").alias("sarif_rule"),
    )


def npm_dependencies(files: DataFrame) -> DataFrame:
    """(path, section, name, version) of package.json files."""
    sections = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    maps = F.array(*[F.struct(F.lit(s).alias("section"), F.from_json(F.get_json_object("content", f"$.{s}"), "map<string,string>").alias("m")) for s in sections])
    return files.filter(F.col("path").rlike(r"(^|/)package\.json$")).select("path", F.inline(maps)).filter("m is not null").select("path", "section", F.explode("m").alias("name", "version"))


def npm_lock(files: DataFrame) -> DataFrame:
    """(path, name, version, is_dev) of lockfiles with a packages map; a package of several uses counts as dev only if all are."""
    m = F.from_json(F.get_json_object("content", "$.packages"), "map<string,struct<version:string,dev:boolean,name:string>>")
    rows = files.filter(F.col("path").rlike(r"(^|/)package-lock\.json$")).select("path", F.explode(m).alias("k", "v")).filter("k <> '' and v.version is not null")
    name = F.coalesce("v.name", F.regexp_extract("k", r"node_modules/((?:@[^/]+/)?[^/]+)$", 1))
    return rows.groupBy("path", F.lower(name).alias("name"), F.col("v.version").alias("version")).agg(F.bool_and(F.coalesce("v.dev", F.lit(False))).alias("is_dev"))


def python_requirements(files: DataFrame) -> DataFrame:
    """(path, name, version, pinned) of requirements files; options, URLs and paths are skipped."""
    rows = files.filter(F.col("path").rlike(r"(^|/)requirements[^/]*\.txt$")).select("path", F.explode(F.split("content", "\n")).alias("l")).select("path", F.trim(F.regexp_replace("l", r"\s*(#|;).*$", "")).alias("l"))
    rows = rows.filter((F.col("l") != "") & ~F.col("l").rlike(r"^-|://|^[./]"))
    name = F.regexp_extract("l", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    version = F.regexp_extract("l", r"(?:===?|>=|~=|<=|>|<|!=)\s*([^,\s]+)", 1)
    return rows.select("path", python_name(name).alias("name"), F.nullif(version, F.lit("")).alias("version"), F.col("l").rlike(r"[^=!<>~]===?\s*[^*,\s]+$").alias("pinned")).filter("name <> ''")


# The properties that name the JDK, the first that is there counts.
JDK_PROPERTIES = ["java.version", "maven.compiler.release", "maven.compiler.source", "maven.compiler.target"]


def _element(text: Column, name: str) -> Column:
    """The text of the first <name> in text, null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, f"<{name}>([^<]*)</{name}>", 1)), F.lit(""))


def _interpolated(value: Column, properties: Column, rounds: int = 8) -> Column:
    """value with each ${name} replaced by its property, over and over, so that properties made of others resolve; null where one has
    no value, or where a ring of names never ends."""
    whole = r"^([^$]*)\$\{([^}]+)\}(.*)$"

    def once(v: Column, _: Column) -> Column:
        part = lambda i: F.regexp_extract(v, whole, i)
        return F.when(v.rlike(whole), F.concat(part(1), F.try_element_at(properties, part(2)), part(3))).otherwise(v)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), value, once)
    return F.when(~F.contains(out, F.lit("${")), out)


def maven_modules(files: DataFrame) -> DataFrame:
    """(path, name, jdk, properties, body) of pom.xml files: a module's own name, the JDK that it asks for, and its properties, which
    name themselves by project.version and the like too. body is what is left without comments."""
    text = F.regexp_replace("content", r"(?s)<!--.*?-->", "")
    poms = files.filter(F.col("path").rlike(r"(^|/)pom\.xml$")).select("path", text.alias("body"))
    block = F.regexp_extract("body", r"(?s)<properties>(.*?)</properties>", 1)
    entry = r"<([\w.-]+)>([^<]*)</"
    pairs = F.transform(F.regexp_extract_all(block, F.lit(entry), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, entry, 1).alias("k"), F.trim(F.regexp_extract(x, entry, 2)).alias("v")))
    own = F.regexp_replace("body", r"(?s)<(parent|dependencies|dependencyManagement|build|profiles|properties|modules|reporting)>.*?</\1>", "")
    parent = F.regexp_extract("body", r"(?s)<parent>(.*?)</parent>", 1)
    told = [F.struct(F.lit(f"project.{k}").alias("k"), F.coalesce(_element(own, k), _element(parent, k)).alias("v")) for k in ("groupId", "version")]
    told += [F.struct(F.lit(f"project.parent.{k}").alias("k"), _element(parent, k).alias("v")) for k in ("groupId", "version")]
    every = F.filter(F.concat(pairs, F.array(*told)), lambda x: x["v"].isNotNull())
    # The first of equal names counts.
    first = F.aggregate(every, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))
    # A generator keeps the properties from being worked out at each use.
    df = poms.select("*", F.inline(F.array(F.struct(F.map_from_entries(first).alias("properties"), _element(own, "artifactId").alias("artifact")))))
    jdk = F.coalesce(*[_interpolated(F.try_element_at("properties", F.lit(p)), F.col("properties")) for p in JDK_PROPERTIES])
    folder = F.nullif(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1), F.lit(""))
    return df.select("path", F.coalesce("artifact", folder, F.lit("maven-module")).alias("name"), jdk.alias("jdk"), "properties", "body")


def maven_dependencies(files: DataFrame) -> DataFrame:
    """(path, coordinate, version) of pom.xml files: the parent, and the dependencies of the module itself; those that are only managed
    or belong to a plug-in or a profile are left out. ${names} are resolved within the file; what can't be has no version."""
    m = maven_modules(files)
    own = F.regexp_replace("body", r"(?s)<(dependencyManagement|build|profiles|reporting)>.*?</\1>", "")
    listed = F.regexp_extract_all(own, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    parent = F.regexp_extract_all("body", F.lit(r"(?s)<parent>(.*?)</parent>"), F.lit(1))
    rows = m.select("path", "properties", F.explode(F.concat(parent, listed)).alias("d")).withColumn("d", F.regexp_replace("d", r"(?s)<exclusions>.*?</exclusions>", ""))
    value = lambda name: _interpolated(_element(F.col("d"), name), F.col("properties"))
    rows = rows.select("path", value("groupId").alias("g"), value("artifactId").alias("a"), value("version").alias("version")).filter("g is not null and a is not null")
    return rows.select("path", F.lower(F.concat_ws(":", "g", "a")).alias("coordinate"), "version")


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """(path, coordinate, version) of Gradle files, after comments are cut."""
    text = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)(?<!:)//.*$", "")
    p = r"(?:implementation|api|compile|compileOnly|runtimeOnly|testImplementation)[\s(]+['\"]([^'\":]+:[^'\":]+(?::[^'\":]+)?)['\"]"
    rows = files.filter(F.col("path").rlike(r"\.gradle(\.kts)?$")).select("path", F.explode(F.regexp_extract_all(text, F.lit(p), F.lit(1))).alias("c"))
    parts = F.split("c", ":")
    return rows.select("path", F.lower(F.concat_ws(":", parts[0], parts[1])).alias("coordinate"), F.try_element_at(parts, F.lit(3)).alias("version"))


def msbuild_projects(files: DataFrame) -> DataFrame:
    """(path, target_framework, is_sdk_style, packages, references) of project files."""
    p = files.filter(F.col("path").rlike(r"(?i)\.(csproj|vbproj|fsproj)$"))
    framework = F.coalesce(*[F.nullif(F.regexp_extract("content", f"<{t}>([^<]+)</{t}>", 1), F.lit("")) for t in ("TargetFramework", "TargetFrameworks", "TargetFrameworkVersion")])
    packages = F.transform(F.regexp_extract_all("content", F.lit(r'<PackageReference\s+[^>]*Include="([^"]+)"'), F.lit(1)), lambda x: x)
    return p.select("path", F.split(framework, ";")[0].alias("target_framework"), F.col("content").rlike(r"<Project[^>]+Sdk=").alias("is_sdk_style"), packages.alias("packages"), F.transform(F.regexp_extract_all("content", F.lit(r'<ProjectReference\s+[^>]*Include="([^"]+)"'), F.lit(1)), lambda x: F.replace(x, F.lit("\\"), F.lit("/"))).alias("references"))


def solution_projects(files: DataFrame) -> DataFrame:
    """(path, project) of .sln and .slnx files."""
    s = files.filter(F.col("path").rlike(r"(?i)\.slnx?$"))
    found = F.concat(F.regexp_extract_all("content", F.lit(r'Project\("\{[^}]+\}"\)\s*=\s*"[^"]*",\s*"([^"]+proj)"'), F.lit(1)), F.regexp_extract_all("content", F.lit(r'<Project\s+Path="([^"]+)"'), F.lit(1)))
    return s.select("path", F.explode(F.transform(found, lambda x: F.replace(x, F.lit("\\"), F.lit("/")))).alias("project"))


OSV = "struct<id:string,withdrawn:string,summary:string,severity:array<struct<type:string,score:string>>,affected:array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>>"


def osv_segments(entries: DataFrame, column: str = "entry") -> DataFrame:
    """(id, ecosystem, name, introduced, fixed, last_affected, vector) of the version segments of OSV entries.

    Withdrawn entries are skipped. vector is that of CVSS 3, else that of CVSS 4. Events fold in their order: each introduced opens a segment that the next fixed or
    last_affected event closes; one that nothing closes stays open.
    """
    e = entries.select(F.from_json(column, OSV).alias("e")).select("e.*").filter("withdrawn is null")
    first = lambda kind: F.get(F.filter("severity", lambda s: s["type"].startswith(kind)), F.lit(0))["score"]
    a = e.select("id", F.coalesce(first("CVSS_V3"), first("CVSS_V4")).alias("vector"), F.explode("affected").alias("a")).select("id", "vector", F.col("a.package.ecosystem").alias("ecosystem"), F.lower("a.package.name").alias("name"), F.explode("a.ranges").alias("r")).filter("r.type <> 'GIT'")
    seg = "array<struct<introduced:string,fixed:string,last_affected:string>>"
    start = F.array().cast(seg)
    none = F.lit(None).cast("string")

    def fold(acc: Column, ev: Column) -> Column:
        opened = F.concat(acc, F.array(F.struct(ev["introduced"].alias("introduced"), none.alias("fixed"), none.alias("last_affected"))))
        last = F.element_at(acc, -1)
        closed = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["introduced"].alias("introduced"), ev["fixed"].alias("fixed"), ev["last_affected"].alias("last_affected"))))
        return F.when(ev["introduced"].isNotNull(), opened).when(F.size(acc) > 0, closed).otherwise(acc)

    rows = a.select("id", "ecosystem", "name", "vector", F.explode(F.aggregate("r.events", start, fold)).alias("s"))
    return rows.select("id", "ecosystem", "name", F.when(F.col("s.introduced") != "0", F.col("s.introduced")).alias("introduced"), "s.fixed", "s.last_affected", "vector")


def git_churn(log: DataFrame) -> DataFrame:
    """(path, commits, lines_added, lines_deleted, authors, first_change, last_change) from numstat lines.

    log: (n, text), n in file order; a header line is 'commit<TAB>hash<TAB>epoch<TAB>email<TAB>name'. Bots are left out.
    Renames written 'a => b' count for the new path, and what a file was called before counts for its newest name.
    """
    from .manifests import renamed_paths

    from pyspark.sql import Window

    parts = F.split("text", "\t")
    header = F.when(F.col("text").startswith("commit\t"), F.struct(parts[1].alias("hash"), F.timestamp_seconds(parts[2].try_cast("long")).alias("at"), parts[3].alias("email"), parts[4].alias("name")))
    w = Window.partitionBy("repo").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("h", F.last(header, ignorenulls=True).over(w)).filter(F.col("text").rlike(r"^(\d+|-)\t(\d+|-)\t"))
    path = F.regexp_replace(F.regexp_replace(parts[2], r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    rows = rows.select("repo", F.regexp_replace(path, "//", "/").alias("path"), F.coalesce(parts[0].try_cast("int"), F.lit(0)).alias("a"), F.coalesce(parts[1].try_cast("int"), F.lit(0)).alias("d"), "h.*").filter(~is_bot(F.col("email"), F.col("name")))
    rows = rows.join(renamed_paths(log), ["repo", "path"], "left").withColumn("path", F.coalesce("alias", "path")).drop("alias")
    return rows.groupBy("repo", "path").agg(F.countDistinct("hash").alias("commits"), F.sum("a").alias("lines_added"), F.sum("d").alias("lines_deleted"), F.countDistinct(author_key(F.col("email"), F.col("name"))).alias("authors"), F.min("at").alias("first_change"), F.max("at").alias("last_change"))


def sql_objects(files: DataFrame) -> DataFrame:
    """(path, kind, name, line) of CREATE statements in SQL files."""
    from .workspace import lines

    p = r"(?i)^\s*CREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(TABLE|VIEW|PROCEDURE|PROC|FUNCTION|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\[\]\"`\w.]+)"
    rows = lines(files.filter(F.col("path").rlike(r"(?i)\.sql$"))).withColumn("kind", F.lower(F.regexp_extract("text", p, 1))).filter("kind <> ''")
    return rows.select("path", F.when(F.col("kind") == "proc", "procedure").otherwise(F.col("kind")).alias("kind"), F.regexp_replace(F.regexp_extract("text", p, 2), r"[\[\]\"`]", "").alias("name"), "line")


def sql_columns(files: DataFrame) -> DataFrame:
    """(path, table, column, line): column lines belong to the last table created before them and not closed since."""
    from pyspark.sql import Window

    from .workspace import lines

    rows = lines(files.filter(F.col("path").rlike(r"(?i)\.sql$")))
    table = F.when(F.col("text").rlike(r"(?i)^\s*CREATE\s+TABLE"), F.regexp_replace(F.regexp_extract("text", r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\[\]\"`\w.]+)", 1), r"[\[\]\"`]", "")).when(F.col("text").rlike(r"^\s*\)"), "")
    rows = rows.withColumn("table", F.last(table, ignorenulls=True).over(Window.partitionBy("path").orderBy("line")))
    column = F.regexp_extract("text", r"^\s*[\[\"`]?(\w+)[\]\"`]?\s+(?i:n?varchar|n?char|int|bigint|smallint|decimal|numeric|date|datetime2?|timestamp|text|bit|bool|boolean|uuid|money|float|real|serial)", 1)
    return rows.filter(F.col("table") != "").withColumn("column", column).filter("column <> '' and not text rlike '(?i)^\\\\s*create'").select("path", "table", "column", "line")


def session_usage(lines_: DataFrame, column: str = "text") -> DataFrame:
    """(day, model, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, requests, sessions) from JSON lines of
    assistant messages; a message that was logged twice counts once."""
    schema = "struct<type:string,timestamp:timestamp,sessionId:string,requestId:string,message:struct<id:string,model:string,usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>>>"
    m = lines_.select(F.from_json(column, schema).alias("j")).select("j.*").filter("type = 'assistant' and message.usage is not null")
    m = m.withColumn("key", F.concat_ws("|", "message.id", "requestId")).dropDuplicates(["key"])
    n = lambda c: F.sum(F.coalesce(f"message.usage.{c}", F.lit(0)))
    return m.groupBy(F.to_date("timestamp").alias("day"), F.col("message.model").alias("model")).agg(n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"), n("cache_read_input_tokens").alias("cache_read_tokens"), n("cache_creation_input_tokens").alias("cache_write_tokens"), F.count(F.lit(1)).alias("requests"), F.countDistinct("sessionId").alias("sessions"))


def coverage_packages(files: DataFrame) -> DataFrame:
    """(path, package, line_rate) of Cobertura files; rates outside 0 to 1 are dropped."""
    rows = files.filter(F.col("content").contains("<coverage")).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"<package\s+[^>]*>"), F.lit(0))).alias("p"))
    rate = F.regexp_extract("p", r'line-rate="([^"]+)"', 1).try_cast("double")
    return rows.select("path", F.regexp_extract("p", r'name="([^"]*)"', 1).alias("package"), rate.alias("line_rate")).filter("line_rate between 0 and 1")


# Sections that name servers, and hosts that are the machine itself.
SERVER_SECTIONS = ["mcpServers", "servers", "mcp_servers", "context_servers"]
LOCAL_HOSTS = ["localhost", "0.0.0.0", "host.docker.internal", "::1", "[::1]"]


def _looks_secret(value: Column) -> Column:
    """A value of 16 characters or more without blanks, references or paths that mixes letters and digits."""
    return F.coalesce((F.length(value) >= 16) & value.rlike(r"^[^\s${}/\\\\]+$") & value.rlike("[A-Za-z]") & value.rlike("[0-9]"), F.lit(False))


def mcp_servers(files: DataFrame) -> DataFrame:
    """(path, server, command, url, transport, host, remote, args, env_keys, secrets) of MCP configuration files; comments and trailing
    commas are allowed.

    Servers come from the sections' objects, from their arrays (by name, or server-0 and on), and from experimental transports
    (continue-0 and on). command is the program's name alone; host has its port where it isn't the usual one; remote is any host but
    this machine. secrets counts literal values in args, env and headers that look like keys. What is of another type is as if
    it weren't there.
    """
    text = F.regexp_replace(F.regexp_replace("content", r"(?m)(^|[\s,{\[])//[^\n\"]*$", "$1"), r"(?s)/\*.*?\*/", "")
    text = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    get = lambda v, path, kind: F.try_variant_get(v, f"$.{path}", kind)
    named = lambda name, v: F.struct(name.alias("server"), v.alias("v"))
    none = F.array().cast("array<struct<server:string,v:variant>>")

    def sections(root: Column) -> Column:
        parts = []
        for s in SERVER_SECTIONS:
            parts.append(F.transform(F.map_entries(get(root, s, "map<string,variant>")), lambda e: named(e["key"], e["value"])))
            parts.append(F.transform(get(root, s, "array<variant>"), lambda e, i: named(F.coalesce(get(e, "name", "string"), F.concat(F.lit("server-"), i.cast("string"))), e)))
        inner = get(root, "experimental.modelContextProtocolServers", "array<variant>")
        parts.append(F.transform(inner, lambda e, i: named(F.concat(F.lit("continue-"), i.cast("string")), F.coalesce(get(e, "transport", "variant"), e))))
        return F.concat(*[F.coalesce(p, none) for p in parts])

    f = files.filter(F.col("path").rlike(r"(?i)mcp[^/]*\.json$|claude_desktop_config\.json$|(^|/)\.(cursor|vscode|continue|gemini|windsurf)/"))
    rows = f.select("path", F.try_parse_json(text).alias("root")).select("path", F.inline(sections(F.col("root"))))
    v = F.col("v")
    string = lambda path: F.when(F.schema_of_variant(get(v, path, "variant")) == "STRING", F.trim(get(v, path, "string")))
    rows = rows.select("path", "server", string("command").alias("full"), string("url").alias("url"), F.lower(string("type")).alias("type"), F.coalesce(get(v, "args", "array<string>"), F.array().cast("array<string>")).alias("args"), get(v, "env", "map<string,string>").alias("env"), get(v, "headers", "map<string,string>").alias("headers"))
    command = F.regexp_extract("full", r"([^/\\]*)$", 1)
    parts = r"(?i)^([a-z][a-z0-9+.-]*)://(?:[^/@?#]*@)?(\[[^\]]*\]|[^:/?#]+)(?::(\d+))?"
    part = lambda i: F.regexp_extract("url", parts, i)
    usual = F.when(F.lower(part(1)) == "http", "80").when(F.lower(part(1)) == "https", "443")
    name = F.nullif(F.lower(part(2)), F.lit(""))
    host = F.when((part(3) == "") | part(3).eqNullSafe(usual), name).otherwise(F.concat(name, F.lit(":"), part(3)))
    told = F.when(F.col("type").isin("stdio", "sse"), F.col("type")).when(F.col("type").isin("http", "streamable-http", "streamablehttp"), "http")
    transport = F.coalesce(told, F.when(F.col("url").isNotNull(), "http").when(F.col("full").isNotNull(), "stdio").otherwise("unknown"))
    remote = F.coalesce(~name.isin(LOCAL_HOSTS) & ~name.startswith("127."), F.lit(False))
    values = lambda c: F.coalesce(F.map_values(c), F.array().cast("array<string>"))
    literal = F.concat(F.transform("args", lambda a: F.regexp_replace(a, "^[^=]*=", "")), values("env"), F.transform(values("headers"), lambda h: F.regexp_replace(h, "(?i)^bearer ", "")))
    keys = F.array_sort(F.coalesce(F.map_keys("env"), F.array().cast("array<string>")))
    return rows.select("path", "server", command.alias("command"), "url", transport.alias("transport"), host.alias("host"), remote.alias("remote"), "args", keys.alias("env_keys"), F.size(F.filter(literal, _looks_secret)).alias("secrets"))
