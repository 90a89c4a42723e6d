"""Classify paths: forbidden areas, sensitive names, allowed roots, write protection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.session import materialize

# Areas nobody may touch, names nobody may read, roots, protected file names.
FORBIDDEN = (
    "C:\\Windows", "C:\\Windows\\System32", "C:\\Windows\\SysWOW64", "/etc", "/sys", "/proc",
    "/boot", "C:\\Program Files", "C:\\Program Files (x86)",
)
SENSITIVE = (
    ".env", ".gitconfig", "id_rsa", "id_ed25519", "known_hosts", "authorized_keys",
    "credentials", "secret", ".aws/credentials", ".ssh/", "password", "token",
)
ALLOWED = ("C:\\Users", "/home")
WRITE_PROTECTED = ("settings.json", "docker-compose.yml", "Dockerfile", ".env")

# Reasons.
REASON_FORBIDDEN = "系统目录禁止访问: "
REASON_SENSITIVE = "敏感文件禁止访问: 包含 '"
REASON_OUTSIDE = "路径不在允许范围内，仅允许访问用户目录和项目目录"
REASON_PROTECTED = "禁止覆盖配置文件: "

# A scheme has two letters or more; one letter is a drive.
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]+):"
KNOWN_SCHEMES = ("file", "hdfs", "viewfs")


@dataclass(frozen=True)
class PathRules:
    """A rule set. Rules are configuration, so they become part of the expressions."""

    forbidden: tuple[str, ...] = FORBIDDEN
    sensitive: tuple[str, ...] = SENSITIVE
    allowed: tuple[str, ...] = ALLOWED
    protected: tuple[str, ...] = WRITE_PROTECTED
    base: str = "/home"


def normalize(path: Column, base: str = "/home") -> Column:
    """Absolute form with ``/`` between segments and without ``.``, ``..`` or empty ones.

    Relative paths start at ``base``. A drive letter counts as the root. Links are not
    resolved: the path is judged as text. Of a URI with a known scheme the path is judged,
    whatever its host; one with another scheme stays as it is, so no root allows it.
    """
    given = F.replace(path, F.lit("\\"), F.lit("/"))
    scheme = F.lower(F.regexp_extract(given, _SCHEME, 1))
    bare = F.regexp_replace(F.regexp_replace(given, _SCHEME + "(//[^/]*)?", ""), "^/([A-Za-z]:)", "$1")
    foreign = (scheme != "") & ~scheme.isin(*KNOWN_SCHEMES)
    slashed = F.when(scheme == "", given).otherwise(bare)
    drive = slashed.rlike("^[A-Za-z]:")
    rooted = F.when(drive | slashed.startswith("/"), slashed).otherwise(
        F.concat(F.lit(base.replace("\\", "/") + "/"), slashed))
    has_drive = rooted.rlike("^[A-Za-z]:")
    root_size = F.when(has_drive, 1).otherwise(0)
    kept = F.aggregate(
        F.split(rooted, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, root_size)))
        .otherwise(F.concat(acc, F.array(x))))
    whole = F.concat(F.when(has_drive, F.lit("")).otherwise(F.lit("/")), F.array_join(kept, "/"))
    return F.when(foreign, given).otherwise(whole)


def _clean(rule: str) -> str:
    return rule.replace("\\", "/").lower().rstrip("/")


def within(path: Column, base: str) -> Column:
    """True for ``base`` itself and everything below it, ignoring case."""
    p, b = F.rtrim(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit("/")), _clean(base)
    return (p == b) | p.startswith(b + "/")


def sensitive_rule(path: Column, rules: tuple[str, ...] = SENSITIVE) -> Column:
    """The first listed name a path segment equals or starts with followed by a dot, or null.

    Names with a slash inside must match neighbouring segments.
    """
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    whole = F.concat(F.lit("/"), p, F.lit("/"))
    chain = None
    for rule in rules:
        name = _clean(rule).strip("/")
        if "/" in name:
            hit = F.contains(whole, F.lit(f"/{name}/"))
        else:
            hit = F.contains(whole, F.lit(f"/{name}/")) | F.contains(whole, F.lit(f"/{name}."))
        chain = F.when(hit, F.lit(rule)) if chain is None else chain.when(hit, F.lit(rule))
    return F.lit(None).cast("string") if chain is None else chain


def read_reason(path: Column, rules: PathRules = PathRules()) -> Column:
    """Null when a normalized path may be read, else the first reason against it."""
    forbidden = F.coalesce(*[F.when(within(path, r), F.lit(REASON_FORBIDDEN + r))
                             for r in rules.forbidden], F.lit(None).cast("string"))
    name = sensitive_rule(path, rules.sensitive)
    inside = F.lit(False)
    for root in rules.allowed:
        inside = inside | within(path, root)
    return F.coalesce(
        forbidden,
        F.when(name.isNotNull(), F.concat(F.lit(REASON_SENSITIVE), name, F.lit("'"))),
        F.when(~inside, F.lit(REASON_OUTSIDE)))


def write_reason(path: Column, rules: PathRules = PathRules()) -> Column:
    """Like :func:`read_reason`, and protected file names may not be overwritten."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(read_reason(path, rules), F.when(
        name.isin(*rules.protected), F.concat(F.lit(REASON_PROTECTED), name)))


def classify(paths: DataFrame, rules: PathRules = PathRules(), for_write: bool = False) -> DataFrame:
    """Add normalized, allowed and reason (empty when allowed) to rows with a ``path``."""
    judge = write_reason if for_write else read_reason
    # A lambda's argument is worked out once, however many rules look at it.
    judged = F.get(F.transform(F.array(normalize(F.col("path"), rules.base)), lambda p: F.struct(
        p.alias("normalized"), judge(p, rules).alias("reason"))), F.lit(0))
    return paths.withColumn("_judged", judged).select(
        *paths.columns, F.col("_judged.normalized").alias("normalized"),
        F.col("_judged.reason").isNull().alias("allowed"),
        F.coalesce("_judged.reason", F.lit("")).alias("reason"))


def gate(files: DataFrame, rules: PathRules = PathRules()) -> tuple[DataFrame, DataFrame]:
    """(rows that may be read, (path, reason) of the others): to go in front of every file tool."""
    judged = classify(files, rules)
    return (judged.filter("allowed").select(*files.columns),
            judged.filter(~F.col("allowed")).select("path", "reason"))


def rule_rows(spark: SparkSession, rules: PathRules = PathRules()) -> DataFrame:
    """A rule set as a table (kind, ord, rule), for ``classify_by_rules``."""
    kinds = {"forbidden": rules.forbidden, "sensitive": rules.sensitive, "allowed": rules.allowed,
             "protected": rules.protected}
    return spark.createDataFrame([(kind, i, rule) for kind, listed in kinds.items() for i, rule in enumerate(listed)],
                                 "kind string, ord long, rule string")


def _keyed_rules(rules: DataFrame) -> DataFrame:
    """(kind, key, depth, ord, rule): what a part of a path must equal for a rule to hold."""
    clean = F.rtrim(F.lower(F.replace("rule", F.lit("\\"), F.lit("/"))), F.lit("/"))
    name = F.trim(clean, F.lit("/"))
    key = F.when(F.col("kind") == "sensitive", name).when(F.col("kind") == "protected", F.col("rule")).otherwise(clean)
    return rules.select("kind", key.alias("key"), F.size(F.split(name, "/")).alias("depth"), "ord", "rule")


def classify_by_rules(paths: DataFrame, rules: DataFrame, for_write: bool = False, base: str = "/home") -> DataFrame:
    """Like :func:`classify`, by a table of rules (kind, ord, rule) of any length.

    Every different path is taken apart once: into its prefixes, its names with what comes before
    each dot, and its runs of neighbouring names as long as the longest rule. These meet the
    rules by equality, so ten thousand rules cost no more than ten, and the least ``ord`` wins.
    """
    judged = paths.withColumn("_normal", normalize(F.col("path"), base))
    keyed = materialize(_keyed_rules(rules), "path-rules")
    longest = keyed.filter("kind = 'sensitive'").agg(F.max("depth")).first()[0] or 1
    normal = judged.select("_normal").distinct()
    lowered = F.rtrim(F.lower("_normal"), F.lit("/"))
    parts = normal.select("_normal", F.split(lowered, "/").alias("segments"),
                          F.element_at(F.split("_normal", "/"), -1).alias("name"))
    segments = F.col("segments")

    def joined(start: Column, size: Column) -> Column:
        return F.array_join(F.slice(segments, start, size), "/")

    def keys(kind: str, of: Column) -> Column:
        return F.transform(of, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    ends = F.sequence(F.lit(1), F.size(segments))
    prefixes = F.transform(ends, lambda n: joined(F.lit(1), n))
    names = F.flatten(F.transform(segments, lambda s: F.transform(
        F.sequence(F.lit(1), F.size(F.split(s, r"\."))), lambda n: F.array_join(
            F.slice(F.split(s, r"\."), F.lit(1), n), "."))))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(1, longest))), lambda n: F.transform(
        F.filter(ends, lambda i: (n > 1) & (i + n - 1 <= F.size(segments))), lambda i: joined(i, n))))
    exploded = parts.select("_normal", F.explode(F.array_distinct(F.concat(
        keys("forbidden", prefixes), keys("allowed", prefixes), keys("sensitive", F.concat(names, runs)),
        F.array(F.struct(F.lit("protected").alias("kind"), F.col("name").alias("key")))))).alias("k")).select(
        "_normal", "k.*")
    first = exploded.join(keyed, ["kind", "key"]).groupBy("_normal").pivot(
        "kind", ["forbidden", "sensitive", "allowed", "protected"]).agg(F.min_by("rule", "ord"))
    reason = F.coalesce(
        F.concat(F.lit(REASON_FORBIDDEN), F.col("forbidden")),
        F.concat(F.lit(REASON_SENSITIVE), F.col("sensitive"), F.lit("'")),
        F.when(F.col("allowed").isNull(), F.lit(REASON_OUTSIDE)),
        F.concat(F.lit(REASON_PROTECTED), F.col("protected")) if for_write else F.lit(None).cast("string"), F.lit(""))
    told = first.select(F.col("_normal").alias("_of"), "forbidden", "sensitive", "allowed", "protected")
    return judged.join(told, F.col("_normal") == F.col("_of"), "left").select(
        *paths.columns, F.col("_normal").alias("normalized"), (reason == "").alias("allowed"), reason.alias("reason"))
