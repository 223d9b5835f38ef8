"""Secret scan: candidates by pattern, false positives removed by a random forest.

DataFrame functions only. A pattern finds long runs of key characters, with or
without digits, and values of any length after a key word and a sign of
assignment; what stands between comes from splitting by the same pattern, so a
candidate's place and neighbours need no word-by-word pass. The forest sees a
candidate's length, character transitions, coverage by dictionary words, the
path it was found under, and the words next to it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, plain, replacing, write_table

#: A value after a key word and = or :, to the closing quote or, unquoted, to white space; the first looks back are cheap and turn most places away.
KEY = r"(?i:passw(?:or)?d|pass[_\- ]?(?:phrase|code)|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|auth|bearer|credentials?|private[_\- ]?key|client[_\- ]?id|signature)[\w\-]{0,12}[\"'`]?[ \t]{0,3}[=:]{1,2}[ \t]{0,3}"
VALUE = rf"(?<=[\"'`])(?<=[=:][ \t]{{0,3}}[\"'`])(?<={KEY}[\"'`])[^\"'`\n]+(?=[\"'`])|(?<=[=:\s])(?<=[=:][ \t]{{0,3}})(?<={KEY})[^\s\"'`]*[^\s\"'`.,;:)\]}}>]"
#: A run of one character over and over holds no secret, and is a candidate only as such a value.
RUN = rf"{VALUE}|(?!([A-Za-z0-9+/_\-])\1*+(?![A-Za-z0-9+/_\-]))[A-Za-z0-9+/_\-]{{16,}}+={{0,2}}"
#: Places are summed in blocks of so many runs.
BLOCK = 64
NEAR = 48
# Words that speak for and against a secret next to it, path parts, and the dictionary.
FOR = "token|secret|passw|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private|client.?id|signature"
AGAINST = "commit|sha1|sha256|sha512|md5|digest|checksum|hash|uuid|guid|etag|revision|version|build|image|base64|isbn|serial|order|phone|card|iban|example|sample|dummy|placeholder|http|www"
PATHS = "test|spec|fixture|mock|example|sample|doc|readme|lock|vendor|node_modules|dist"
WORDS = "about|account|action|address|array|before|button|cache|class|client|column|config|content|count|create|data|date|default|delete|document|error|event|example|field|file|filter|first|format|function|get|group|handler|header|height|image|index|input|insert|item|label|length|level|list|load|local|log|main|manager|message|method|model|module|name|number|object|option|output|page|param|path|point|position|process|query|read|record|report|request|response|result|return|search|select|server|service|session|set|size|source|start|state|status|store|string|style|system|table|target|task|template|test|text|time|title|type|update|user|value|version|view|width|window|write"

FEATURES = ["f_length", "f_transitions", "f_vowel_turns", "f_digits", "f_upper", "f_hex", "f_distinct", "f_repeats", "f_dictionary", "f_slashes", "f_separators", "f_symbols", "f_path", "f_for", "f_against", "f_assigned", "f_quoted", "f_glued"]
ADDED = ("start", "length", "value", "score", "is_secret")


def features(value: Column, left: Column, right: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1))
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    low = F.lower(value)
    turns = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z]", ""), "[aeiouy]", "0"), "[a-z]", "1")
    runs = lambda s: F.length(F.regexp_replace(s, r"(.)\1*+", "x"))
    share = lambda drop: 1 - F.length(F.regexp_replace(value, drop, "")) / n
    flag = lambda text, pattern: F.lower(text).rlike(pattern).cast("double")
    tail, head = F.regexp_replace(left, r"^.*\n", ""), right
    return {
        "f_length": n.cast("double"), "f_transitions": runs(kind) / n, "f_vowel_turns": runs(turns) / F.greatest(F.length(turns), F.lit(1)), "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"),
        "f_hex": share("[0-9a-f]"), "f_distinct": F.size(F.array_distinct(F.split(value, ""))) / n, "f_repeats": 1 - runs(value) / n, "f_dictionary": 1 - F.length(F.regexp_replace(low, WORDS, "")) / n,
        "f_slashes": share("/"), "f_separators": share(r"[_\-]"), "f_symbols": share(r"[^A-Za-z0-9+/_=\-]"), "f_path": flag(path, PATHS), "f_for": flag(F.concat(tail, F.lit(" "), value), FOR), "f_against": flag(tail, AGAINST),
        "f_assigned": flag(tail, r"""[=:]\s*["'`]?$"""), "f_quoted": (flag(tail, """["'`]$""") + flag(head, """^["'`]""")), "f_glued": (flag(tail, r"[\w.@%/&]$") + flag(head, r"^[\w.@%]")),
    }


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per candidate: the columns of ``docs`` but text, with start (0-based, in characters), length, value, left, right, path."""
    docs = replacing(docs, *ADDED, "left", "right", "path", *FEATURES) if path != "path" else replacing(docs, *ADDED, "left", "right", *FEATURES)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "path")]
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*kept, where.alias("path"), text.alias("text"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("__runs"))
    found = found.filter(F.size("__runs") > 0).withColumn("__gaps", F.split("text", RUN, -1))
    sizes = F.transform("__runs", lambda x, i: F.length(x) + F.length(F.get(F.col("__gaps"), i)))
    found = found.withColumn("__sizes", sizes).withColumn("__blocks", F.transform(F.sequence(F.lit(0), F.floor((F.size("__sizes") - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice("__sizes", b * BLOCK + 1, F.lit(BLOCK)))))
    found = found.withColumn("__before", F.transform("__blocks", lambda _, i: F.when(i == 0, F.lit(0)).otherwise(_sum(F.slice("__blocks", F.lit(1), F.greatest(i, F.lit(1)))))))
    picked = F.sequence(F.lit(0), F.size("__runs") - 1)

    def one(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        inside = F.when(i % BLOCK == 0, F.lit(0)).otherwise(_sum(F.slice("__sizes", block * BLOCK + 1, F.greatest(i % BLOCK, F.lit(1)))))
        gap = F.get("__gaps", i)
        return F.struct((F.get("__before", block) + inside + F.length(gap)).cast("long").alias("start"), F.get("__runs", i).alias("value"), F.right(F.concat(F.coalesce(F.get("__runs", i - 1), F.lit("")), gap), F.lit(NEAR)).alias("left"), F.left(F.coalesce(F.get("__gaps", i + 1), F.lit("")), F.lit(NEAR)).alias("right"))

    out = found.select(*kept, "path", F.explode(F.transform(picked, one)).alias("__c"))
    return out.select(*kept, F.col("__c.start").alias("start"), F.length("__c.value").cast("long").alias("length"), F.col("__c.value").alias("value"), F.col("__c.left").alias("left"), F.col("__c.right").alias("right"), "path")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """A stand-in for an organisation's own labelled findings: (left, value, right, path, label, form) by rule, the same each time."""
    hexes = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("m"), F.col("id")), 512))), "[=+/]", "")
    digits = F.regexp_replace(F.concat(hexes, F.md5(F.col("id").cast("string"))), "[a-f]", "")
    word = lambda salt: F.get(F.array(*[F.lit(w) for w in WORDS.split("|")]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(WORDS.split("|")))).cast("int"))
    letters = F.translate(F.left(mixed, F.lit(60)), "0123456789", "qzjxkvwbph")
    small, syllable = F.lower(letters), lambda salt: F.get(F.array(*[F.lit(a + b) for a in "bdlmnrst" for b in "aeiou"]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(40)).cast("int"))
    pseudo = F.concat(*[syllable(f"s{i}") for i in range(9)])
    spelled = F.concat(syllable("p1"), F.lit("n"), syllable("p2"), syllable("p3"))
    yes = [
        ('"access_key": "', F.left(hexes, F.lit(48)), '"', "src/app.json"), ("api_key: ", F.left(mixed, F.lit(32)), "", "config.yml"), ("secret='", F.left(mixed, F.lit(40)), "'", "settings.py"), ("password = ", F.left(mixed, F.lit(20)), "", "deploy/env"),
        ("AWS_ACCESS_KEY_ID=", F.concat(F.lit("AKIA"), F.upper(F.left(mixed, F.lit(16)))), "", "infra/main.tf"), ("Authorization: Bearer ", F.left(mixed, F.lit(48)), "", "notes.txt"), ("", F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), " ", "src/ci.sh"), ("client_secret=", F.left(hexes, F.lit(32)), "&grant", ""),
        # without digits, short, or with symbols
        ("app password: ", F.left(small, F.lit(16)), "", "notes.txt"), ('password = "', F.left(letters, F.lit(18)), '"', "src/app.py"), ("AWS_ACCESS_KEY_ID=", F.concat(F.lit("AKIA"), F.upper(F.left(letters, F.lit(16)))), "", "infra/main.tf"), ("key id ", F.concat(F.lit("AKIA"), F.upper(F.left(letters, F.lit(16)))), " ", ""),
        ("passphrase: ", F.concat_ws("-", word("q"), word("r"), word("s"), spelled), "", "notes.txt"), ('passphrase = "', F.concat_ws(" ", word("t"), spelled, word("u"), word("v")), '"', "config.yml"), ("password = ", F.concat(F.left(mixed, F.lit(6)), F.lit("!"), F.right(mixed, F.lit(4)), F.lit("#")), "", "deploy/env"), ("pwd: ", F.left(mixed, F.lit(10)), "", "config.yml"),
    ]
    no = [
        ("commit ", F.left(hexes, F.lit(40)), "", "CHANGELOG"), ("sha256:", hexes, "", "yarn.lock"), ("see https://example.com/", F.left(hexes, F.lit(20)), ".html", ""), ("call ", F.concat(word("a"), F.lit("_"), word("b"), F.lit("_"), word("c"), F.lit("_2")), "(", "src/app.py"),
        ("card ", F.left(digits, F.lit(16)), " ", ""), (" ", F.left(digits, F.lit(16)), ",", ""), ("id ", F.concat_ws("-", F.left(hexes, F.lit(8)), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), " ", ""), ('token = "', F.concat(F.repeat(F.lit("x"), 20), F.lit("1")), '"', "docs/example.md"),
        ('password = "', F.concat(F.lit("your_"), word("d"), F.lit("_password_1")), '"', "README.md"), ("base64,", mixed, "", "index.html"), ("at ", F.concat(F.lit("usr/lib/"), word("e"), F.lit("/"), word("f"), F.lit("/v1")), ".so", ""), ("etag ", F.left(hexes, F.lit(32)), "", "log.txt"),
        ("", F.concat(word("g"), word("h"), word("i"), F.left(digits, F.lit(2))), "@mail", ""), ("we took ", F.concat(word("j"), F.lit("-"), word("k"), F.lit("-"), word("l"), F.left(digits, F.lit(4))), ".", ""),
        # without digits or short
        (" ", F.concat(word("a"), word("b"), word("c")), " ", ""), (" ", pseudo, " ", ""), (" ", F.concat_ws("-", pseudo, spelled), ",", ""), ("in ", F.concat_ws("/", F.lit("usr/lib"), word("d"), word("e"), word("f")), " ", ""), (" ", F.concat_ws("_", word("g"), word("h"), word("i"), word("j")), "(", "src/app.py"), (" ", F.concat(word("k"), F.initcap(word("l")), F.initcap(word("m")), F.initcap(word("n"))), ".", "src/app.py"),
        ('password = "', F.concat(F.lit("your_"), word("o"), F.lit("_here")), '"', "README.md"), ("password: ", word("p"), "", "config.yml"), ("token = ", F.concat(word("q"), F.lit("."), word("r"), F.lit("()")), "", "src/app.py"), ("secret: ", F.lit("None"), "", "settings.py"), ("auth: ", spelled, " ", ""), ("", F.lit("AWS_ACCESS_KEY_ID="), "", "infra/main.tf"), (" ", F.concat(F.repeat(F.lit("=-"), 9), F.lit("-")), " ", ""), ("token: ", F.concat(F.lit("<"), word("s"), F.lit("_token")), ">", "README.md"),
    ]
    every = [(x, 1.0) for x in yes] + [(x, 0.0) for x in no]
    rows = F.array(*[F.struct(F.lit(a).alias("left"), v.alias("value"), F.lit(b).alias("right"), F.lit(p).alias("path"), F.lit(y).alias("label"), F.lit(i).alias("form")) for i, ((a, v, b, p), y) in enumerate(every)])
    return spark.range(0, n, 1, 1).select(F.get(rows, F.pmod("id", F.lit(len(every))).cast("int")).alias("x")).select("x.*")


def _assembled(df: DataFrame) -> DataFrame:
    df = df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in features(F.col("value"), F.col("left"), F.col("right"), F.col("path")).items()})
    return VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(df)


def train(findings: DataFrame, trees: int = 24, depth: int = 7, max_findings: int = 200_000, seed: int = 11) -> RandomForestClassificationModel:
    """A forest from (left, value, right, path, label: 1 secret, 0 not), of which about ``max_findings`` at most, by hash, are used."""
    clean = findings.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("left", "value", "right", "path")], F.col("label").cast("double").alias("label")).filter(F.col("label").isin(0.0, 1.0))
    n = clean.count()
    if n > max_findings:
        clean = clean.filter(F.pmod(F.xxhash64("left", "value", "right", "path"), F.lit(1 << 20)) < int(max_findings / n * (1 << 20)))
    rows, path = write_table(_assembled(clean).select("__features", "label"), "findings")
    model = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(rows)
    drop_table(findings.sparkSession, path)
    return model


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: the columns of ``docs`` but text, start, length, value, score (0 to 1) and is_secret.

    Null, empty and short texts have no candidates; repeated rows repeat their
    findings; whole texts are searched; an empty table gives an empty one;
    input columns with the added names (and text, unless it is ``path``) give
    way, all others stay, whatever their names. ``findings`` are labelled
    examples for the forest; without any, those of :func:`labelled_findings`.
    """
    model = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    inner, names = plain(replacing(docs, *ADDED), "text")
    found = candidates(inner, next(c for c, n in names.items() if n == path) if path else None)
    scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__p").transform(_assembled(found))
    score = F.get(vector_to_array("__p"), F.lit(1))
    return scored.select(*[F.col(c).alias(n) for c, n in names.items() if c != "text"], "start", "length", "value", score.alias("score"), (score >= threshold).alias("is_secret"))
