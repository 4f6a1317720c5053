"""Secret scanning: a wide pattern finds candidates, a random forest drops the false ones.

Candidates are of two kinds: runs of at least twelve letters, digits, + / _ - that hold a letter and a
digit; and what stands after a cue (password, secret, token, key and the like) and = or :, six
characters or more of any kind but white space, quotes and brackets. The forest sees length, class
transitions, distinct characters, dictionary coverage, path marks and the words around; it is
trained on labelled findings (text around a candidate and whether it is secret), by default a set
written by rule from templates of keys, tokens and passwords on one side and checksums, paths,
identifiers, dates and placeholders on the other. The templates and the features come from the same
authors, so held-out templates say nothing of secrets in the wild; give labelled findings for those.

Only DataFrame functions and JVM estimators are used. Defined results: null and empty texts have no
findings; a row is scanned by its own text; repeated candidates of a text are findings of their own,
numbered from 0; null ids stay; without rows there are no findings; extra columns, whatever their
names, are ignored by scan and kept by redact.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.textops import free_names
from graphloom.plans.scratch import materialize

_RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])(?=[0-9+/_\-]*[A-Za-z])[A-Za-z0-9+/_\-]{12,}"
#: Words after which an assigned value is a candidate.
CUES = "passwords?|passwd|pwd|passphrase|passcode|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?"
_ASSIGNED = rf"(?<=[=:]\s?[\"'`]?)(?<=(?i:{CUES})[\"'`]?\s?[=:]\s?[\"'`]?)(?![\s\"'`<>(){{}}\[\]=:])[^\s\"'`<>(){{}}\[\],;]{{6,128}}"
CANDIDATE = f"{_ASSIGNED}|{_RUN}"
#: Characters of text before and after a candidate that the forest may read.
BEFORE, AFTER = 48, 24
#: Findings that the default training set has.
FINDINGS = 6000
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Keys over which copies of one text are spread.
SALTS = 64
# Words that stand near secrets, words that stand near harmless codes, and fragments of ordinary identifiers.
NEAR = "secret|token|passw|pwd|passphrase|api[_ -]?key|apikey|access[_ -]?key|auth|bearer|credential|private|signature"
HARMLESS = "commit|checksum|digest|sha1|sha256|md5|etag|revision|uuid|guid|build|version|isbn|order|invoice|serial|session|hash"
DICTIONARY = "the|and|user|name|data|file|image|page|index|home|test|item|list|view|main|config|report|order|product|version|session|profile|setting|article|section|chapter|photo|video|static|assets|content|upload|download|module|class|table|update|release|backup|number|value|export|import"
# What stands for a secret, or for none.
PLACEHOLDERS = "required|optional|string|varchar|integer|boolean|undefined|changeme|example|redacted|hidden|forgotten|missing|invalid|expired|protected|manager|reset|policy|unknown|incorrect|please|enter|here"
FEATURES = ["len", "digits", "upper", "lower", "marks", "symbols", "switches", "distinct", "hex", "vowels", "dictionary", "path", "assigned", "quoted", "near", "harmless", "prefix", "cued", "placeholder"]


def findings(texts: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """keep columns plus nth, candidate, before, after: one row per candidate of each text."""
    t, c, g, z = free_names(keep, "t", "c", "g", "z")
    some = texts.select(*keep, F.col(text_col).cast("string").alias(t)).where(F.col(t).rlike(CANDIDATE))
    found = some.select(*keep, F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias(c), F.split(t, CANDIDATE).alias(g))
    zipped = F.arrays_zip(F.col(c).alias("c"), F.slice(g, F.lit(1), F.size(c)).alias("b"), F.slice(g, F.lit(2), F.size(c)).alias("a"))
    rows = found.select(*keep, F.posexplode(zipped).alias("nth", z))
    return rows.select(*keep, "nth", F.col(f"{z}.c").alias("candidate"), F.right(F.col(f"{z}.b"), F.lit(BEFORE)).alias("before"), F.left(F.col(f"{z}.a"), F.lit(AFTER)).alias("after"))


def _share(c: Column, drop: str) -> Column:
    return 1 - F.length(F.regexp_replace(c, drop, "")) / F.length(c)


def featured(rows: DataFrame) -> DataFrame:
    c, b, a = F.col("candidate"), F.lower("before"), F.col("after")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "0"), "[a-z]+", "1"), "[A-Z]+", "2")
    values = {
        "len": F.least(F.length(c), F.lit(128)).cast("double"),
        "digits": _share(c, "[0-9]"),
        "upper": _share(c, "[A-Z]"),
        "lower": _share(c, "[a-z]"),
        "marks": _share(c, r"[+/_\-]"),
        "symbols": _share(c, r"[^A-Za-z0-9+/_\-]"),
        "switches": F.length(kinds) / F.length(c),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "hex": F.when(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 1.0).otherwise(0.0),
        "vowels": _share(F.lower(c), "[aeiou]"),
        "dictionary": _share(F.lower(c), DICTIONARY),
        "path": F.when(c.rlike(r"^/|/.*/|[/_\-].*[/_\-].*[/_\-]") | b.rlike(r"[/\\.]$"), 1.0).otherwise(0.0),
        "assigned": F.when(b.rlike(r"[=:]\s*[\"'`]?$"), 1.0).otherwise(0.0),
        "quoted": F.when(b.rlike("[\"'`]$") & a.rlike("^[\"'`]"), 1.0).otherwise(0.0),
        "near": F.when(b.rlike(f"(?:{NEAR})[^\\s]*(?:\\s+[^\\s]*){{0,2}}$"), 1.0).otherwise(0.0),
        "harmless": F.when(b.rlike(f"(?:{HARMLESS})[^\\s]*(?:\\s+[^\\s]*){{0,1}}$"), 1.0).otherwise(0.0),
        "cued": F.when(b.rlike(f"(?:{CUES})[\"'`]?\\s?[=:]\\s?[\"'`]?$"), 1.0).otherwise(0.0),
        "placeholder": F.when(F.lower(c).rlike(f"^(?:{PLACEHOLDERS})[.!?]*$|^[$%*x.]|^(?:env|os|self|config|settings)[._]"), 1.0).otherwise(0.0),
        "prefix": F.when(c.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^xox[abp]-|^sk[-_]|^AIza|^glpat-"), 1.0).otherwise(0.0),
    }
    return rows.withColumns(values)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(id, text, label): n texts of one candidate each, written from templates by row number."""
    i = F.col("id")

    def pick(salt: int, *words: str) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(words))) + 1).cast("int"))

    sha = F.sha1(F.concat(F.lit("finding-"), i.cast("string")))
    wide = F.base64(F.unhex(F.sha2(F.concat(F.lit("wide-"), i.cast("string")), 256)))
    plain = F.regexp_replace(wide, "[+/=]", "x")
    caps = F.upper(F.translate(F.substring(plain, 1, 40), "018", "QWZ"))
    word = lambda s: pick(s, "user", "profile", "report", "image", "page", "static", "module", "the", "release", "backup", "content", "photo")
    num = lambda s, m: F.pmod(F.xxhash64(i, F.lit(s)), F.lit(m)).cast("string")
    lead = F.concat(pick(1, "", "of the ", "und der ", "que la ", "see ", "then "), pick(2, "", "in ", "set ", "with ", "por "))
    size = lambda s, lo, hi: (F.pmod(F.xxhash64(i, F.lit(s)), F.lit(hi - lo + 1)) + lo).cast("int")
    cut = lambda col, s, lo, hi: F.substr(col, F.lit(1), size(s, lo, hi))
    true = [
        F.concat(lead, pick(3, "token", "secret", "auth_token", "api_key", "access_key"), pick(4, " = ", "=", ": "), pick(5, '"', "'", ""), cut(sha, 6, 20, 40)),
        F.concat(lead, pick(3, "password", "passwd", "pwd", "passphrase"), pick(4, "=", ": ", " = "), cut(F.md5(sha), 6, 12, 24)),
        F.concat(lead, F.lit("AKIA"), F.substring(caps, 1, 12), F.lpad(num(7, 10000), 4, "2")),
        F.concat(lead, F.lit("Authorization: Bearer "), cut(plain, 6, 24, 43), num(8, 100)),
        F.concat(lead, pick(3, "ghp_", "sk-", "xoxb-", "glpat-"), cut(plain, 6, 20, 36), num(8, 100)),
        F.concat(lead, pick(3, "client_secret", "private key", "credential", "signature"), pick(4, "=", ": ", ":"), pick(5, '"', "'", ""), cut(wide, 6, 20, 43), num(8, 10)),
        F.concat(lead, cut(wide, 6, 32, 43), num(8, 100)),
        F.concat(lead, pick(3, "password", "passwd", "pwd", "token", "secret"), pick(4, "=", ": ", " = "), pick(5, '"', "'", ""), word(9), num(8, 100), pick(7, "!", "#", "&", "$", "?")),
        F.concat(lead, pick(3, "password", "passphrase", "secret"), pick(4, "=", ": ", " = "), pick(5, '"', "'", ""), word(9), F.lit("-"), word(10), F.lit("-"), word(12)),
        F.concat(lead, pick(3, "password", "passwd", "pwd", "passcode"), pick(4, "=", ": "), F.initcap(F.translate(word(9), "aeio", "4310")), num(8, 1000), pick(7, "!", "@", "", "&")),
        F.concat(lead, pick(3, "password", "token", "secret", "api_key"), pick(4, "=", ": "), pick(5, '"', "'", ""), F.translate(cut(sha, 6, 6, 16), "0123456789", "ghjkmnpqrt")),
    ]
    false = [
        F.concat(lead, pick(3, "commit", "sha1", "checksum", "revision", "etag", "md5"), pick(4, " ", ": ", "="), cut(sha, 6, 12, 40)),
        F.concat(lead, pick(3, "uuid ", "guid=", "id ", "session "), F.substring(sha, 1, 8), F.lit("-"), F.substring(sha, 9, 4), F.lit("-4"), F.substring(sha, 13, 3), F.lit("-a"), F.substring(sha, 17, 3), F.lit("-"), F.substring(sha, 21, 12)),
        F.concat(lead, pick(3, "/", "/var/", "https://host/", "src/"), word(9), F.lit("/"), word(10), F.lit("-"), num(11, 3000), F.lit("/"), word(12)),
        F.concat(lead, word(9), F.lit("_"), word(10), F.lit("_"), word(12), num(11, 1000)),
        F.concat(lead, pick(3, "version ", "build ", "order ", "serial "), F.lit("2"), num(11, 1000), F.lit("-"), word(9), F.lit("-"), num(13, 100), F.lit("T"), num(14, 100000)),
        F.concat(lead, word(9), word(10), word(12), num(11, 100)),
        F.concat(lead, F.upper(word(9)), F.lit("-"), num(11, 100000), F.lit("-"), num(13, 100000), F.lit("-"), num(14, 1000)),
        F.concat(lead, word(9), F.lit("/"), word(10), num(11, 100), F.lit("/"), cut(sha, 6, 8, 16), F.lit("-"), word(12)),
        F.concat(lead, pick(3, "password", "token", "secret", "credentials"), pick(4, ": ", "=", " = "), pick(7, *PLACEHOLDERS.split("|"))),
        F.concat(lead, pick(3, "password", "token", "secret", "api_key"), pick(4, "=", ": "), pick(7, "$PASSWORD", "${SECRET}x", "%TOKEN%", "********", "xxxxxxxx", "os.environ", "config.token", "self.password")),
        F.concat(lead, pick(3, "Password", "Token", "The secret"), F.lit(": "), word(9), F.lit(" "), word(10)),
    ]
    choose = lambda cols, s: F.element_at(F.array(*cols), (F.pmod(F.xxhash64(i, F.lit(s)), F.lit(len(cols))) + 1).cast("int"))
    secret = F.pmod(F.xxhash64(i, F.lit(99)), F.lit(2)) == 0
    tail = pick(15, "", " ", '"', ", and", " die")
    return spark.range(n).select("id", F.concat(F.when(secret, choose(true, 21)).otherwise(choose(false, 22)), tail).alias("text"), secret.cast("double").alias("label"))


def train(labelled: DataFrame, trees: int = 40, depth: int = 9, seed: int = 3) -> PipelineModel:
    """labelled: (text, label), every candidate of a text having its label."""
    rows = materialize(featured(findings(labelled, ["label"], "text")).select("label", *FEATURES), "features")  # the fit reads them again and again
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)]).fit(rows)


_forests: dict[str, PipelineModel] = {}


def own_forest(spark: SparkSession) -> PipelineModel:
    """The forest of labelled_findings; as they never differ, an application trains it once."""
    app = spark.sparkContext.applicationId
    if app not in _forests:
        _forests.clear()
        _forests[app] = train(materialize(labelled_findings(spark), "labelled"))
    return _forests[app]


def _scored(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows of findings with score and is_secret; no column of theirs may be named like a feature."""
    p = vector_to_array("probability")[1]
    return model.transform(featured(rows)).select(*rows.columns, p.alias("score"), (p >= THRESHOLD).alias("is_secret"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, labelled: DataFrame | None = None) -> DataFrame:
    """One row per candidate: id_col, nth, candidate, before, after, score, is_secret."""
    model = train(labelled) if labelled is not None else own_forest(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"))
    return _scored(findings(rows, ["row_id"], "row_text"), model).withColumnRenamed("row_id", id_col)


def redact(docs: DataFrame, text_col: str = "text", *, labelled: DataFrame | None = None) -> DataFrame:
    """docs with every confirmed secret replaced by MASK where it stands.

    Rows meet their findings by a hash of their text and one of SALTS numbers taken from the other
    columns, so copies of a text are not one key.
    """
    model = train(labelled) if labelled is not None else own_forest(docs.sparkSession)
    may = F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False))  # only these texts are shuffled
    plain = [f.name for f in docs.schema.fields if f.name != text_col and f.dataType.typeName() in ("long", "integer", "string", "double", "date", "timestamp")]
    key, salt, where = free_names(docs.columns, "key", "salt", "where")
    own = docs.where(may).withColumns({key: F.xxhash64(text_col), salt: F.pmod(F.xxhash64(*plain, F.lit(1)), F.lit(SALTS)).cast("int")})
    texts = own.select(F.col(key).alias("row_key"), F.col(salt).alias("row_salt"), F.col(text_col).alias("row_text")).dropDuplicates(["row_key", "row_salt"])
    found = _scored(findings(texts, ["row_key", "row_salt"], "row_text"), model).where("is_secret")
    per = found.groupBy(F.col("row_key").alias(key), F.col("row_salt").alias(salt)).agg(F.collect_set("nth").alias(where))
    c, g = F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0)), F.split(text_col, CANDIDATE)
    said = F.transform(c, lambda x, i: F.when(F.array_contains(F.col(where), i), F.lit(MASK)).otherwise(x))
    clean = F.concat(g[0], F.array_join(F.zip_with(said, F.slice(g, F.lit(2), F.size(c)), lambda x, y: F.concat(x, y)), ""))
    out = own.join(per, [key, salt], "left")
    return out.withColumn(text_col, F.when(F.col(where).isNull(), F.col(text_col)).otherwise(clean)).select(*docs.columns).union(docs.where(~may))
