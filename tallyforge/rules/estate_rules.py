"""Rules over projects and packages: migration blockers, legacy frameworks of Java and Python, AI use of an estate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import jdk_major, version_major
from ..operators.latest import latest_per_key

# Blockers by the package or assembly that tells of them; =: exact name, ^: prefix.
BLOCKERS = [
    ("mb-003", 3, "assemblies", "=", ["System.Web"]),
    ("mb-004", 2, "packages", "=", ["Microsoft.AspNet.Mvc"]),
    ("mb-005", 2, "packages", "^", ["Microsoft.AspNet.WebApi"]),
    ("mb-006", 2, "packages", "=", ["EntityFramework"]),
    ("mb-007", 3, "assemblies", "=", ["System.ServiceModel"]),
    ("mb-008", 3, "assemblies", "=", ["System.Runtime.Remoting"]),
    ("mb-009", 3, "assemblies", "^", ["System.Activities", "System.Workflow"]),
    ("mb-010", 3, "assemblies", "=", ["System.Messaging"]),
    ("mb-011", 2, "assemblies", "=", ["System.Windows.Forms", "PresentationFramework"]),
    ("mb-012", 2, "packages", "^", ["Microsoft.Owin"]),
    ("mb-013", 2, "packages", "^", ["EnterpriseLibrary"]),
]
WEB_API_CLIENT = "microsoft.aspnet.webapi.client"
# Legacy frameworks by coordinate; below a major version, or any.
LEGACY_JAVA = [
    ("log4j:log4j", "Log4j 1.x", None, 3),
    ("org.apache.struts:struts-core", "Struts 1", None, 3),
    ("struts:struts", "Struts 1", None, 3),
    ("org.apache.axis:axis", "Apache Axis 1", None, 3),
    ("org.springframework:spring-core", "Spring Framework 4.x or older", 5, 2),
    ("org.springframework:spring-context", "Spring Framework 4.x or older", 5, 2),
    ("org.springframework.boot:spring-boot-starter-parent", "Spring Boot 1.x", 2, 3),
    ("org.springframework.boot:spring-boot-starter", "Spring Boot 1.x", 2, 3),
    ("org.springframework.boot:spring-boot-starter-web", "Spring Boot 1.x", 2, 3),
    ("org.hibernate:hibernate-core", "Hibernate ORM 4.x or older", 5, 2),
    ("commons-httpclient:commons-httpclient", "Commons HttpClient 3", None, 2),
    ("javax.faces:jsf-api", "JSF 1.x (javax.faces)", None, 2),
]
LEGACY_PYTHON = [
    ("django", "Django 1.x", 2, 3),
    ("django", "Django 2.x", 3, 2),
    ("flask", "Flask 0.x/1.x", 2, 2),
    ("celery", "Celery 4.x or older", 5, 2),
    ("tornado", "Tornado 5.x or older", 6, 2),
    ("nose", "nose", None, 2),
    ("pycrypto", "PyCrypto", None, 3),
]


def migration_blockers(projects: DataFrame) -> DataFrame:
    """(path, rule_id, severity, evidence) from projects (path, is_sdk_style, packages, assemblies, packages_config)."""

    def first(column: str, kind: str, names: list[str]) -> Column:
        low = [n.lower() for n in names]

        def hit(x: Column) -> Column:
            v = F.lower(x)
            if kind == "=":
                return v.isin(low)
            out = v.startswith(low[0])
            for n in low[1:]:
                out = out | v.startswith(n)
            return out & (v != WEB_API_CLIENT)

        return F.try_element_at(F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), hit), F.lit(1))

    found = [(F.when(~F.col("is_sdk_style"), F.lit("project format")), "mb-001", 2), (F.when(F.col("packages_config") > 0, F.concat(F.lit("packages.config with "), F.col("packages_config").cast("string"))), "mb-002", 2)]
    found += [(first(column, kind, names), code, severity) for code, severity, column, kind, names in BLOCKERS]
    structs = F.array(*[F.struct(F.lit(f"dependency.migration-blocker.{code}").alias("rule_id"), F.lit(severity).alias("severity"), e.alias("evidence")) for e, code, severity in found])
    return projects.select("path", F.inline(structs)).filter("evidence is not null")


def legacy_frameworks(modules: DataFrame, rows: list[tuple], prefix: str) -> DataFrame:
    """(rule_id, name, severity, path, version) of packages (path, coordinate, version) in a table of legacy rows.

    The first row that fits a package counts; each framework is told once, at the first path. A row with a limit fits
    only literal versions below it.
    """
    table = modules.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, coordinate string, name string, below int, severity int")
    major = F.when(F.col("version").rlike(r"^\d"), version_major(F.col("version")))
    hit = modules.withColumn("coordinate", F.lower("coordinate")).join(table, "coordinate").filter(F.col("below").isNull() | (major < F.col("below")))
    per = latest_per_key(hit, ["path", "coordinate"], [F.col("place")])
    once = latest_per_key(per, ["name"], [F.col("path"), F.col("coordinate")])
    return once.select(F.lit(f"{prefix}.legacy-framework").alias("rule_id"), "name", "severity", "path", "version")


def old_jdk(modules: DataFrame) -> DataFrame:
    """(path, jdk, severity): below 17; 8 and older are High."""
    jdk = jdk_major(F.col("jdk"))
    return modules.withColumn("jdk", jdk).filter("jdk < 17").select("path", "jdk", F.when(F.col("jdk") <= 8, 3).otherwise(2).alias("severity"))


def javax_modules(imports: DataFrame) -> DataFrame:
    """(path, groups): modules whose imports lie in javax packages that moved, by group."""
    group = F.regexp_extract("name", r"^(javax\.(?:servlet|persistence|ws|faces|ejb|jms|mail|validation|annotation|xml\.bind))", 1)
    return imports.withColumn("g", group).filter("g <> ''").groupBy("path").agg(F.array_sort(F.collect_set("g")).alias("groups"))


def python_floor(projects: DataFrame) -> DataFrame:
    """(path, severity): a floor that admits Python 2 is High, 3.9 or older Medium."""
    floor = F.regexp_extract("requires", r">=?\s*(\d+(?:\.\d+)?)", 1)
    major, minor = F.split(floor, r"\.")[0].try_cast("int"), F.coalesce(F.try_element_at(F.split(floor, r"\."), F.lit(2)).try_cast("int"), F.lit(0))
    severity = F.when(major < 3, 3).when((major == 3) & (minor <= 9), 2)
    return projects.withColumn("severity", severity).filter("severity is not null").select("path", "severity")


# Package prefixes of AI vendors and frameworks.
AI_PACKAGES = [("openai", "openai", "sdk"), ("@anthropic-ai/", "anthropic", "sdk"), ("anthropic", "anthropic", "sdk"), ("google-generativeai", "google", "sdk"), ("@google/generative-ai", "google", "sdk"), ("mistralai", "mistral", "sdk"), ("cohere", "cohere", "sdk"), ("langchain", "langchain", "framework"), ("@langchain/", "langchain", "framework"), ("llama-index", "llama-index", "framework"), ("ollama", "ollama", "local-runtime"), ("transformers", "huggingface", "framework")]


def ai_packages(packages: DataFrame) -> DataFrame:
    """(path, name, provider, kind): each package with the longest prefix of AI_PACKAGES that it begins with."""
    table = packages.sparkSession.createDataFrame(AI_PACKAGES, "prefix string, provider string, kind string")
    names = packages.select("name").distinct()
    best = names.join(table, F.lower("name").startswith(F.col("prefix"))).groupBy("name").agg(F.max_by(F.struct("provider", "kind"), F.length("prefix")).alias("s"))
    return packages.join(best, "name").select("path", "name", "s.provider", "s.kind")


def ai_findings(packages: DataFrame, endpoints: DataFrame, models: DataFrame, servers: DataFrame, approved: list[str] | None = None) -> DataFrame:
    """(rule_id, severity, file_path, symbol) of the rules over an estate's use of AI.

    packages: path, name, provider, kind (sdk, framework, local-runtime), as ai_packages gives; endpoints: path, provider, local;
    models: path, model, retired_on; servers: path, server, transport, has_secret. The inventory is there where anything is.
    """
    row = lambda df, rule, severity, symbol, path=F.col("path"): df.select((rule if isinstance(rule, Column) else F.lit(rule)).alias("rule_id"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), path.alias("file_path"), symbol.alias("symbol"))
    kind = F.when(F.col("kind") == "framework", "ai.agent.framework").when(F.col("kind") == "local-runtime", "ai.local-runtime").otherwise("ai.provider.sdk")
    remote = F.col("transport").isin("http", "sse", "streamable-http")
    used = packages.filter("kind = 'sdk'").select("provider").unionByName(endpoints.filter("not local").select("provider")).distinct()
    told = packages.select("path").unionByName(endpoints.select("path")).unionByName(servers.select("path"))
    none = F.lit(None).cast("string")
    parts = [
        row(told.agg(F.count(F.lit(1)).alias("n")).filter("n > 0"), "ai.inventory", 0, F.lit("ai-estate"), none),
        row(packages, kind, 0, F.lower("name")),
        row(endpoints, F.when(F.col("local"), "ai.local-runtime").otherwise("ai.provider.direct-endpoint"), F.when(F.col("local"), 0).otherwise(1), F.col("provider")),
        row(models.filter("retired_on is not null"), "ai.model.retired", 2, F.col("model")),
        row(servers, "ai.mcp.server", 1, F.col("server")),
        row(servers.filter(remote), "ai.mcp.remote-server", 2, F.col("server")),
        row(servers.filter("has_secret"), "ai.mcp.secret-in-config", 3, F.col("server")),
    ]
    if approved is not None:
        parts.append(row(used.filter(~F.lower("provider").isin([a.lower() for a in approved])), "ai.unapproved-provider", 3, F.col("provider"), none))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def unapproved_providers(found: DataFrame, approved: list[str] | None) -> DataFrame:
    """Providers outside the allow-list; without one nothing is unapproved."""
    if approved is None:
        return found.limit(0)
    return found.filter(~F.lower("provider").isin([a.lower() for a in approved]) & (F.col("kind") != "local-runtime"))


def estate_rollup(found: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """(key, providers, frameworks, packages, personal_data, secrets): AI use beside open personal-data and secret findings."""
    use = found.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "sdk", F.col("provider")))).alias("providers"), F.array_sort(F.collect_set(F.when(F.col("kind") == "framework", F.col("provider")))).alias("frameworks"), F.count(F.lit(1)).alias("packages"))
    risk = findings.filter(F.col("status").isin("Open", "Regressed")).groupBy(key).agg(F.count_if(F.col("rule_id").startswith("privacy.")).alias("personal_data"), F.count_if(F.col("rule_id").startswith("secrets.")).alias("secrets"))
    return use.join(risk, key, "left").fillna(0, ["personal_data", "secrets"])


# The kind of a provider that data leaves the estate for, and what rules of personal data and of AI begin with.
EXTERNAL, PERSONAL, AI = "external-api", "privacy.pii.", "ai."


def estate_records(inventories: DataFrame, key: str) -> DataFrame:
    """(key, catalog_version, providers, frameworks, mcp, remote_mcp, secrets_in_mcp, retired, allowlist, unapproved, external) of AI
    inventories (key, data): data is a JSON object whose estateJson is the inventory as JSON text.

    The inventory is read as a variant, so a part that is missing, of another type or written by an older version is empty and the rest
    stands; what is no JSON, or no object, gives no row. providers: (id, name, kind, approved).
    """
    get = lambda v, path, kind: F.try_variant_get(v, f"$.{path}", kind)
    kind_of = lambda v: F.schema_of_variant(v)

    def some(v: Column, path: str, kind: str) -> Column:
        """The elements of an array that are of a kind; none where there is no array."""
        return F.filter(F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>")), lambda e: kind_of(e).startswith(kind))

    def text(v: Column, path: str, default: Column | None = None) -> Column:
        at = get(v, path, "variant")
        found = F.when(kind_of(at) == "STRING", get(v, path, "string"))
        return found if default is None else F.coalesce(found, default)

    truth = lambda v, path: F.when(kind_of(get(v, path, "variant")) == "BOOLEAN", get(v, path, "boolean"))
    strings = lambda v, path: F.transform(some(v, path, "STRING"), lambda e: F.try_variant_get(e, "$", "string"))
    e = inventories.select(key, F.try_parse_json(F.get_json_object("data", "$.estateJson")).alias("e")).filter(F.schema_of_variant("e").startswith("OBJECT"))
    v = F.col("e")
    provider = lambda x: F.struct(text(x, "id", F.lit("?")).alias("id"), text(x, "name", text(x, "id", F.lit("?"))).alias("name"), text(x, "kind", F.lit(EXTERNAL)).alias("kind"), truth(x, "approved").alias("approved"))
    whole = F.when(F.schema_of_variant(get(v, "secretsInMcp", "variant")) == "BIGINT", get(v, "secretsInMcp", "long"))
    # Generators keep parts from being read again at each use.
    e = e.select(key, "e", F.inline(F.array(F.struct(F.transform(some(v, "providers", "OBJECT"), provider).alias("providers"), some(v, "mcp", "OBJECT").alias("servers")))))
    return e.select(
        key,
        text(v, "catalog.version", F.lit("—")).alias("catalog_version"),
        "providers",
        F.transform(some(v, "frameworks", "OBJECT"), lambda x: text(x, "name", F.lit("?"))).alias("frameworks"),
        F.size("servers").alias("mcp"),
        F.size(F.filter("servers", lambda x: F.coalesce(truth(x, "remote"), F.lit(False)))).alias("remote_mcp"),
        F.coalesce(whole, F.lit(0)).alias("secrets_in_mcp"),
        F.size(some(v, "models.retired", "OBJECT")).alias("retired"),
        F.coalesce(truth(v, "allowlist.configured"), F.lit(False)).alias("allowlist"),
        strings(v, "allowlist.unapproved").alias("unapproved"),
        F.exists("providers", lambda x: x["kind"] == EXTERNAL).alias("external"),
    )


def estate_rows(records: DataFrame, open_: DataFrame, key: str) -> DataFrame:
    """(key, providers, frameworks, mcp, unapproved, retired, secrets_in_mcp, pii_co_located, secrets_co_located) of records that hold
    anything. open_: key, rule_id, category, n of open findings. The marks tell that an estate talks to an external
    provider and has open findings of personal data, or of secrets that no AI rule found."""
    held = records.filter((F.size("providers") > 0) | (F.col("mcp") > 0) | (F.size("frameworks") > 0))
    counted = F.col("n") > 0
    flags = open_.groupBy(key).agg(F.bool_or(counted & F.col("rule_id").startswith(PERSONAL)).alias("pii"), F.bool_or(counted & (F.col("category") == "Secrets") & ~F.col("rule_id").startswith(AI)).alias("leaks"))
    named = lambda a: F.array_sort(a, lambda x, y: F.when(F.lower(x) < F.lower(y), -1).when(F.lower(x) > F.lower(y), 1).otherwise(0))
    beside = lambda c: F.col("external") & F.coalesce(c, F.lit(False))
    df = held.join(flags, key, "left")
    return df.select(key, named(F.transform("providers", lambda p: p["name"])).alias("providers"), named(F.col("frameworks")).alias("frameworks"), "mcp", F.size("unapproved").alias("unapproved"), "retired", "secrets_in_mcp", beside(F.col("pii")).alias("pii_co_located"), beside(F.col("leaks")).alias("secrets_co_located"))


def estate_totals(records: DataFrame, rows: DataFrame) -> DataFrame:
    """(section, item, value, detail) over the portfolio: counts and sums; how many estates use each provider (detail: its kind) and each
    framework, and in how many each unapproved provider stands. Records without anything count only as scanned."""
    held = records.filter((F.size("providers") > 0) | (F.col("mcp") > 0) | (F.size("frameworks") > 0))
    none = F.lit(None).cast("string")
    line = lambda section, item, value: F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), value.cast("long").alias("value"), none.alias("detail"))
    sums = held.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("mcp", "remote_mcp", "secrets_in_mcp", "retired")], F.coalesce(F.bool_or("allowlist"), F.lit(False)).alias("allowlist"))
    counts = sums.select(F.inline(F.array(line("count", "with_ai", F.col("n")), *[line("count", c, F.col(c)) for c in ("mcp", "remote_mcp", "secrets_in_mcp", "retired")], line("count", "allowlist", F.col("allowlist").cast("int")))))
    scanned = records.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(line("count", "scanned", F.col("n")))))
    marks = rows.agg(F.count_if("pii_co_located").alias("p"), F.count_if("secrets_co_located").alias("s")).select(F.inline(F.array(line("count", "ai_with_pii", F.col("p")), line("count", "ai_with_secrets", F.col("s")))))
    n = F.count(F.lit(1)).alias("value")
    providers = held.select(F.explode("providers").alias("p")).groupBy("p.id").agg(n, F.min("p.kind").alias("detail")).select(F.lit("provider").alias("section"), F.col("id").alias("item"), "value", "detail")
    frameworks = held.select(F.explode("frameworks").alias("item")).groupBy("item").agg(n).select(F.lit("framework").alias("section"), "item", "value", none.alias("detail"))
    unapproved = held.select(F.explode("unapproved").alias("item")).groupBy("item").agg(n).select(F.lit("unapproved").alias("section"), "item", "value", none.alias("detail"))
    out = counts
    for part in (scanned, marks, providers, frameworks, unapproved):
        out = out.unionByName(part)
    return out
