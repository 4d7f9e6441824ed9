"""Rules over files: containers, compose, settings, scripts, security and configuration, duplication. Facts in, candidates out.

Every rule gives (rule_id, severity, file_path, line, symbol).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ladder
from ..sources.workspace import lines

CANDIDATE = ["rule_id", "severity", "file_path", "line", "symbol"]
# Tags of base images that are out of support; * is every tag. Names of settings that only look like secrets.
EOL_IMAGES = {
    "dotnet/aspnet": ["2.1", "2.2", "3.0", "3.1", "5.0", "6.0", "7.0", "9.0"],
    "dotnet/runtime": ["2.1", "2.2", "3.0", "3.1", "5.0", "6.0", "7.0", "9.0"],
    "dotnet/sdk": ["2.1", "2.2", "3.0", "3.1", "5.0", "6.0", "7.0", "9.0"],
    "dotnet/core/aspnet": ["*"], "dotnet/core/runtime": ["*"], "dotnet/core/sdk": ["*"],
    "dotnet/framework/aspnet": ["4.6.2", "4.7", "4.7.1"],
    "node": ["8", "10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "21"],
    "python": ["2", "2.7", "3.5", "3.6", "3.7", "3.8", "3.9"],
    "ubuntu": ["14.04", "16.04", "18.04", "20.04", "trusty", "xenial", "bionic", "focal"],
    "debian": ["7", "8", "9", "10", "11", "wheezy", "jessie", "stretch", "buster", "bullseye"],
    "alpine": ["3.10", "3.11", "3.12", "3.13", "3.14", "3.15", "3.16", "3.17", "3.18", "3.19", "3.20"],
    "nginx": ["1.14", "1.16", "1.18", "1.20", "1.22", "1.24", "1.26"],
    "postgres": ["9.6", "10", "11", "12", "13"],
    "mysql": ["5.5", "5.6", "5.7", "8.0"],
    "redis": ["3", "4", "5", "6", "6.0", "6.2"],
    "mongo": ["3.6", "4.0", "4.2", "4.4", "5.0", "6.0"],
}
SECRET_NAME = r"PASSWORD|PASSWD|SECRET|TOKEN|API_?KEY|APIKEY|PRIVATE_?KEY|CONNECTION_?STRING|ACCESS_?KEY"
BENIGN_NAME = r"(?:^|_)(?:FILE|PATH|ENDPOINT|HEADER|NAME|URL|URI|TTL|LIFETIME|TIMEOUT|EXPIRY|EXPIRATION|MINUTES|SECONDS|HOURS|DAYS|LENGTH|SIZE|VERSION|PROMPT|ID|MOUNT|DIR|PREFIX|SUFFIX|FORMAT|ALGORITHM|ISSUER|AUDIENCE)$"


def _emit(df: DataFrame, rule: Column | str, severity: Column | int, symbol: Column | str, line: str = "line") -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(col(rule).alias("rule_id"), col(severity).cast("int").alias("severity"), F.col("path").alias("file_path"), F.col(line).cast("int").alias("line"), (F.col(symbol) if isinstance(symbol, str) else symbol).alias("symbol"))


def docker(files: DataFrame) -> DataFrame:
    """Unpinned and unsupported base images, a root user in the last stage, secrets in ENV or ARG."""
    rows = lines(files.filter(F.col("path").rlike(r"(?i)(^|/)(Dockerfile(\.[^/]*)?|[^/]*\.Dockerfile)$"))).withColumn("t", F.trim("text"))
    rows = rows.withColumns({"image": F.regexp_extract("t", r"(?i)^FROM\s+(?:--\S+\s+)?(\S+)", 1), "alias": F.lower(F.regexp_extract("t", r"(?i)^FROM\s+.*\s+AS\s+(\S+)", 1))})
    stages = rows.filter("image <> ''")
    aliases = stages.filter("alias <> ''").select("path", F.col("alias").alias("image_key")).distinct()
    base = stages.filter(~F.col("image").contains("$")).withColumn("image_key", F.lower("image")).join(aliases, ["path", "image_key"], "left_anti").filter("lower(image) <> 'scratch'")
    last = F.element_at(F.split("image", "/"), -1)
    tag = F.when(F.col("image").contains("@"), "digest").when(last.contains(":"), F.element_at(F.split(last, ":"), -1))
    name = F.lower(F.when(F.col("image").contains("@"), F.regexp_replace("image", "@.*$", "")).when(last.contains(":"), F.regexp_replace("image", ":[^:/]*$", "")).otherwise(F.col("image")))
    base = base.withColumns({"tag": tag, "name": name})
    version = F.split("tag", "-")[0]
    eol = F.lit(False)
    for image, tags in EOL_IMAGES.items():
        hit = F.lit(True) if "*" in tags else F.coalesce(version.isin(tags) | version.rlike("^(" + "|".join(t.replace(".", r"\.") for t in tags) + r")\."), F.lit(False))
        eol = eol | ((F.col("name") == image) | F.col("name").endswith("/" + image)) & hit
    floating = F.col("tag").isNull() | (F.lower("tag") == "latest")
    images = _emit(base.filter(floating | (eol & (F.col("tag") != "digest"))), F.when(floating, "infra.docker.unpinned-base").otherwise("infra.docker.eol-base"), F.when(floating, 1).otherwise(3), "image")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    staged = rows.withColumn("stage", F.sum((F.col("image") != "").cast("int")).over(w))
    user = F.col("t").rlike(r"(?i)^USER\s+(?!root\b|0\b)\S+")
    per = staged.filter("stage > 0").groupBy("path", "stage").agg(F.min("line").alias("line"), F.bool_or(user).alias("safe")).groupBy("path").agg(F.max_by(F.struct("line", "safe"), "stage").alias("l")).filter("not l.safe").select("path", F.col("l.line").alias("line"))
    root = _emit(per, "infra.docker.root-user", 1, F.lit("USER"))
    told = F.regexp_extract("t", r"(?i)^(?:ENV|ARG)\s+(.*)$", 1)
    pair = rf"(?i)[A-Za-z0-9_.-]*(?:{SECRET_NAME})[A-Za-z0-9_.-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|\S+)"
    spaced = F.regexp_replace(told, r"^([A-Za-z0-9_.-]+)\s+(?!=)(.*)$", "$1=$2")
    env = rows.withColumn("s", F.explode(F.regexp_extract_all(spaced, F.lit(pair), F.lit(0))))
    env = env.withColumns({"n": F.regexp_extract("s", r"^([A-Za-z0-9_.-]+)", 1), "v": F.regexp_replace(F.regexp_extract("s", r"^[A-Za-z0-9_.-]+\s*=\s*(.*)$", 1), "^[\"']|[\"']$", "")})
    secret = _emit(env.filter(~F.col("n").rlike(f"(?i){BENIGN_NAME}") & (F.col("v") != "") & ~F.col("v").startswith("$")), "infra.docker.secret-in-env", 3, "n")
    return images.unionByName(root).unionByName(secret)


def compose(files: DataFrame) -> DataFrame:
    """Privileged services, host networks and mounted Docker sockets inside services:."""
    rows = lines(files.filter(F.col("path").rlike(r"(?i)(^|/)(docker-)?compose[^/]*\.ya?ml$"))).withColumn("t", F.trim("text")).filter((F.col("t") != "") & ~F.col("t").startswith("#"))
    rows = rows.withColumn("indent", F.length("text") - F.length(F.ltrim("text")))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when(F.col("indent") == 0, F.regexp_replace("t", ":.*$", "")), ignorenulls=True).over(w)).filter("section = 'services' and indent > 0")
    rows = rows.withColumn("level", F.min("indent").over(Window.partitionBy("path")))
    name = F.when((F.col("indent") == F.col("level")) & F.col("t").endswith(":"), F.regexp_replace("t", "[:\"']", ""))
    rows = rows.withColumn("service", F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit("?")))
    kind = ladder([(F.col("t").rlike(r"^privileged:\s*[\"']?true"), "infra.compose.privileged"), (F.col("t").rlike(r"^network_mode:\s*[\"']?host"), "infra.compose.host-network"), (F.col("t").contains("/var/run/docker.sock"), "infra.compose.docker-socket")])
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    return _emit(rows, F.col("kind"), F.when(F.col("kind") == "infra.compose.host-network", 2).otherwise(3), "service")


def settings(files: DataFrame) -> DataFrame:
    """Verbose default logging and detailed errors in settings that are not for development."""
    f = files.filter(F.col("path").rlike(r"(?i)(^|/)appsettings[^/]*\.json$") & ~F.col("path").rlike(r"(?i)(Development|Local|Test)[^/]*$"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?m)(^|\s)//[^\n]*$", ""), r"(?s)/\*.*?\*/", ""), r",(\s*[}\]])", "$1")
    f = f.withColumns({"level": F.get_json_object(text, "$.Logging.LogLevel.Default"), "detailed": F.lower(F.get_json_object(text, "$.DetailedErrors")), "line": F.lit(None).cast("int")})
    verbose = _emit(f.filter(F.col("level").isin("Debug", "Trace")), "infra.appsettings.verbose-logging", 1, F.lit("Logging:LogLevel:Default"))
    return verbose.unionByName(_emit(f.filter("detailed = 'true'"), "infra.appsettings.detailed-errors", 2, F.lit("DetailedErrors")))


# Rule ids and severities. The line patterns, by file kind, are this library's own.
LINE_RULES = [
    ("javascript.eval", 3, r"(?i)\.(js|jsx|ts|tsx|html?|cshtml)$", r"\beval\s*\(|new\s+Function\s*\("),
    ("javascript.dom-injection", 2, r"(?i)\.(js|jsx|ts|tsx|html?|cshtml)$", r"\.innerHTML\s*=|document\.write\s*\(|dangerouslySetInnerHTML"),
    ("javascript.insecure-url", 1, r"(?i)\.(js|jsx|ts|tsx)$", r"['\"]http://(?!localhost|127\.)"),
    ("sec.crypto.weak-hash", 2, r"(?i)\.(cs|vb|java|py)$", r"\bMD5\b|\bSHA1\b|hashlib\.(md5|sha1)\s*\(|getInstance\(\s*\"(MD5|SHA-?1)\""),
    ("sec.crypto.weak-cipher", 3, r"(?i)\.(cs|vb|java)$", r"\bDES(CryptoServiceProvider)?\b|\bRC2\b|TripleDES|\"DES/"),
    ("sec.sql.string-concatenation", 3, r"(?i)\.(cs|vb|java|py)$", r"(?i)\"\s*(select|insert|update|delete)\b[^\"]*\"\s*(\+|&|%|\.format)"),
    ("sec.deserialization.binaryformatter", 3, r"(?i)\.(cs|vb)$", r"\bBinaryFormatter\b"),
    ("sec.tls.certificate-validation-disabled", 3, r"(?i)\.(cs|vb|py|java)$", r"ServerCertificateValidationCallback|verify\s*=\s*False|TrustAllCerts"),
    ("sec.deserialization.typenamehandling", 3, r"(?i)\.(cs|vb)$", r"\bTypeNameHandling\s*(?:=\s*|\.)(?:TypeNameHandling\.)?(?:All|Auto|Objects|Arrays)\b"),
    ("sec.tls.legacy-protocol", 2, r"(?i)\.(cs|vb)$", r"\bSecurityProtocolType\.(?:Ssl3|Tls|Tls11)\b(?!1)|\bSslProtocols\.(?:Ssl2|Ssl3|Tls|Tls11)\b"),
    ("sec.xml.dtd-processing", 2, r"(?i)\.(cs|vb)$", r"\bDtdProcessing\.Parse\b|\bnew\s+XmlUrlResolver\b|\bProhibitDtd\s*=\s*(?i:false)"),
    ("sec.web.request-validation-disabled", 2, r"(?i)\.(cs|vb|cshtml|aspx)$", r"\bValidateInput\s*\(\s*(?i:false)\s*\)|ValidateRequest\s*=\s*\"?(?i:false)"),
    ("sec.process.command-concatenation", 2, r"(?i)\.(cs|vb)$", r"\bProcess\.Start\s*\([^;]*(?:\+|&|\$\")"),
    ("sec.config.debug-enabled", 2, r"(?i)web\.config$", r"<compilation[^>]*debug=\"true\""),
    ("sec.config.custom-errors-off", 2, r"(?i)web\.config$", r"<customErrors[^>]*mode=\"Off\""),
    ("sec.config.trace-enabled", 2, r"(?i)web\.config$", r"<trace[^>]*enabled=\"true\""),
    ("sec.config.cookies-not-httponly", 2, r"(?i)web\.config$", r"httpOnlyCookies=\"false\""),
]


def line_rules(files: DataFrame, most_per_rule: int | None = None) -> DataFrame:
    """Matches of LINE_RULES by line. most_per_rule: only the first of each rule by path and line, ranked in each task first."""
    rows = lines(files)
    found = F.filter(F.array(*[F.when(F.col("path").rlike(p) & F.col("text").rlike(rx), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p, rx in LINE_RULES]), lambda x: x.isNotNull())
    out = rows.withColumn("f", F.explode(found)).select(F.col("f.rule").alias("rule_id"), F.col("f.severity").alias("severity"), F.col("path").alias("file_path"), F.col("line").cast("int").alias("line"), F.left(F.trim("text"), F.lit(80)).alias("symbol"))
    if most_per_rule is None:
        return out
    w = Window.partitionBy("rule_id").orderBy("file_path", "line")
    return out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most_per_rule).drop("r")


def script_tags(files: DataFrame) -> DataFrame:
    """(path, src) of script tags."""
    return files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)<script[^>]*\ssrc=[\"']([^\"']+)[\"']"), F.lit(1))).alias("src"))


def duplicate_blocks(rows: DataFrame, doc: str, text: str, window: int = 8, least: int = 12) -> DataFrame:
    """(doc, first_line, last_line): maximal runs of lines that lie in windows of `window` normalized lines found elsewhere.

    Blank lines do not count. Each line's window is hashed once; windows found twice or more are marked by a grouped
    count joined back, and runs of marked lines come from gaps between them. Runs shorter than `least` are left out.
    """
    norm = F.regexp_replace(F.lower(F.trim("raw")), r"\s+", " ")
    ln = rows.select(doc, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("raw", norm).filter("raw <> ''")
    order = Window.partitionBy(doc).orderBy("line")
    ln = ln.withColumn("n", F.row_number().over(order))
    block = F.concat_ws("\n", F.collect_list("raw").over(order.rowsBetween(0, window - 1)))
    full = F.count("raw").over(order.rowsBetween(0, window - 1))
    ln = ln.withColumns({"h": F.xxhash64(block), "full": full})
    twice = ln.filter(F.col("full") == window).groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    starts = ln.filter(F.col("full") == window).join(twice, "h", "left_semi").select(doc, "n")
    covered = starts.select(doc, F.explode(F.sequence("n", F.col("n") + window - 1)).alias("n")).distinct()
    island = F.col("n") - F.row_number().over(Window.partitionBy(doc).orderBy("n"))
    runs = covered.withColumn("g", island).groupBy(doc, "g").agg(F.min("n").alias("a"), F.max("n").alias("b")).filter(F.col("b") - F.col("a") + 1 >= least)
    at = ln.select(F.col(doc).alias("_d"), F.col("n").alias("_n"), "line")
    first = runs.join(at, (F.col(doc) == F.col("_d")) & (F.col("a") == F.col("_n"))).select(doc, "g", "b", (F.col("line") + 1).alias("first_line"))
    return first.join(at, (F.col(doc) == F.col("_d")) & (F.col("b") == F.col("_n"))).select(doc, "first_line", (F.col("line") + 1).alias("last_line"))
