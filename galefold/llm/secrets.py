"""Operator 4: secret scans whose false positives a random forest removes. DataFrame functions and Spark ML only.

Candidates are all runs of eight or more value characters with a digit among them, and,
whatever its characters, the right-hand side of an assignment to a credential's name
(in quotes up to the closing quote or a blank, else up to a blank or the next assignment;
four characters or more, since redaction replaces a value wherever it stands alone in its text),
and the password in user:password@host of a link.
A name ends at its = or :, so in name=value the value stands alone; a scheme's word (Basic, Bearer) is no value. One row each, with
the words around them. Features: length, changes between kinds of characters, share of
the value that dictionary words cover (the dictionary is counted over all documents),
how unlikely its letters follow each other in the dictionary, long runs of letters and digits,
the look of code, the path they come from, the neighbouring words, and whether they lie in the
body of a private key or of a link's user:password. A forest is trained on labelled findings and gives every
finding a probability. Without a table of these, findings are planted: into the
surroundings of words of at most PLANTED_TEXTS texts (in the order of a hash) each phrase
of PLANTS is put, credentials and things that look like them, and a finding's label is
what was planted, not what its features say.

Only the forest's training uses a sample: those texts, and at most MAX_LABELLED findings of
each label. Candidates, dictionary and scores cover whole texts of all rows.

Defined results: null, empty and blank texts have no findings; a null source is an
empty path, and so is a missing column; repeated rows give repeated findings; without
labelled findings of both kinds a finding's probability is its `label`, which a strict rule
gives where it is sure, or 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, table

MAX_LABELLED = 20_000
#: Texts that phrases are planted in at most, and words that stay on either side.
PLANTED_TEXTS, PLANTED_WORDS = 120, 6
TREES, DEPTH, SEED = 30, 9, 42
#: Occurrences that make a word part of the dictionary.
DICTIONARY_COUNT = 20
REDACTED = "[SECRET]"

_SPACE = r"[\x20\x09-\x0D]+"
#: A run of value characters, a digit among them; = only as padding at its end.
_CANDIDATE = r"(?=[A-Za-z+/_.@~-]*[0-9])[A-Za-z0-9+/_.@~-]{8,}+(?:={1,2}(?![A-Za-z0-9+/_.@=~-]))?"
# Names of credentials, and shapes that aren't secrets.
_NAMES = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|apikey)"
_NAME = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)[A-Za-z0-9_.-]*"
#: In words joined by blanks, a credential's name, its operator and (group 1) the value.
_NAMED = (
    r"(?i)(?:" + _NAME + r"\\?[\"'`]?\]? ?(?:=>|:=|={1,3}|:) ?(?:(?:bearer|basic) )?|\bbearer |(?<![A-Za-z0-9_-])--?[a-z-]*" + _NAME + r" )\\?[\"'`]?"
    r"(?!(?:bearer|basic|digest|negotiate)(?: |$))((?<=\")[^\" ]{4,}|(?<=')[^' ]{4,}|(?<=`)[^` ]{4,}|[^\"'` =:>](?:(?![&,;?][A-Za-z0-9_.-]+[\"']?[=:]|[,;)}\]\"'`]+(?: |$))[^ ]){3,})"
)
_HAS_NAME = r"(?i)" + _NAME
#: The password of user:password@host.
_USERINFO = r"://[^/:@\"'` ]*:([^/\"'` ]{4,})@(?=[A-Za-z0-9\[])"
#: Words that open the body of a private key, and the word that closes it.
_OPENS, _CLOSES = r"PRIVATE (KEY-----|KEY BLOCK-----)$", r"^-----END$"
_TEST_PATH = r"(?i)(test|example|sample|mock|fixture|demo)"
_NUMBER = r"^[0-9.+/=_-]+$"
_ADDRESS = r"@|^(https?|www)|\.(com|org|net|html?)\b"
_RUN = r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])(?<![A-Za-z0-9])[A-Za-z0-9]{20,}"
_CODE = r"^[\p{L}_]+(\.[\p{L}_]+)*[(\[]|^[\p{L}_]+(\.[\p{L}_]+)+$"
_SAID = r"(?i)\b(key|token|secret|password|passphrase|passcode)s? (is|was|are):?$"
_CHANGES = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"

_PLACEHOLDER = r"(?i)(example|sample|change.?me|your|placeholder|dummy|redacted|secret_?name|x{4,}|\*{3,}|^[<{$%\[(])"
_KNOWN = r"^(AKIA|ASIA)[A-Z0-9]{12,}$|^(gh[pousr]|sk|pk|xox[abps]|glpat)[_-]|^eyJ|^AIza"

FEATURES = ["value_length", "changes", "transitions", "number", "address", "placeholder", "known_prefix", "digit_share", "upper_share", "vowel_share", "distinct_share", "mark_share", "hex", "dictionary", "path_length", "path_depth", "path_test", "named_before", "named_near", "assigned", "quoted", "word_before", "word_after", "userinfo", "private_key", "long_runs", "code", "said"]


#: Phrases to plant: label, wording with {v}, and the kinds of value that take its place.
PLANTS = (
    (1, 'token = "{v}"', ("hex40", "base64", "mixed", "github")),
    (1, "api_key='{v}'", ("hex32", "mixed", "stripe")),
    (1, '{{"user":"bob","password":"{v}","n":1}}', ("hex18", "phrase", "marked", "mixed")),
    (1, "password={v}", ("hex18", "phrase", "marked", "mixed")),
    (1, 'password: "{v}"', ("phrase", "marked", "hex18")),
    (1, "passwd := {v}", ("marked", "phrase", "mixed")),
    (1, "db_password={v} db_host=localhost", ("marked", "phrase", "hex18")),
    (1, "export AWS_SECRET_ACCESS_KEY={v}", ("base64",)),
    (1, "client_secret: {v}", ("base64", "hex40", "mixed")),
    (1, "Authorization: Bearer {v}", ("base64", "mixed", "hex40")),
    (1, "run --password {v} now", ("phrase", "marked", "mixed")),
    (1, "https://h.example/?token={v}&page=2", ("hex18", "mixed")),
    (1, "{v}", ("amazon", "github", "stripe")),
    (1, "access_key = {v}", ("amazon", "mixed")),
    (1, "{v}", ("web_token",)),
    (1, "Cookie: session={v};", ("web_token",)),
    (1, "postgres://admin:{v}@db.example:5432/main", ("phrase", "marked", "mixed", "hex18")),
    (1, "clone https://bot:{v}@code.example/repo", ("mixed", "github", "hex40")),
    (1, "-----BEGIN RSA PRIVATE KEY----- {v} -----END RSA PRIVATE KEY-----", ("line64",)),
    (1, "-----BEGIN PRIVATE KEY----- {v} -----END PRIVATE KEY-----", ("line64",)),
    (1, "https:{v}", ("hook",)),
    (1, "the key is {v}", ("hex32", "hex40", "mixed")),
    (1, "Authorization: Basic {v}", ("base64",)),
    (0, "{v}", ("digits16", "digits10", "mail", "host", "date", "link", "file", "release", "word_number", "joined")),
    (0, "call ({v}", ("phone",)),
    (0, "call {v}", ("phone", "digits10")),
    (0, "{v},", ("digits16", "mail", "link", "joined")),
    (0, "commit {v}", ("hex40",)),
    (0, "sha256: {v}", ("hex64",)),
    (0, "checksum {v}", ("hex32", "hex64")),
    (0, "id={v}", ("uuid", "digits10")),
    (0, "request {v} took", ("uuid",)),
    (0, "version: {v}", ("release",)),
    (0, 'name = "{v}"', ("joined", "word_number", "file")),
    (0, 'user: "{v}"', ("mail", "joined")),
    (0, "url={v}", ("link",)),
    (0, 'password = "{v}"', ("stand_in",)),
    (0, "api_key: {v}", ("stand_in",)),
    (0, "token={v}", ("stand_in",)),
    (0, "password: {v}", ("plain_word",)),
    (0, "the secret: {v}", ("plain_word",)),
    (0, "-----BEGIN CERTIFICATE----- {v} -----END CERTIFICATE-----", ("line64",)),
    (0, "data:image/png;base64, {v}", ("line64",)),
    (0, "https:{v}", ("page", "commit_page")),
    (0, "token = {v})", ("call",)),
    (0, "password = {v})", ("call",)),
    (0, "secret = {v}", ("attribute",)),
    (0, "api_key={v}", ("attribute",)),
    (0, "ftp://user:{v}@host.example/", ("stand_in",)),
    (0, "the number is {v}", ("digits10", "digits16")),
)
STAND_INS = ("changeme", "your_api_key_here", "<your-token>", "********", "${SECRET_NAME}", "example123", "xxxxxxxxxxxx", "{{token}}", "placeholder1", "required")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _path(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def row_key(docs: DataFrame) -> Column:
    """What a finding depends on: the text and its path."""
    return F.md5(F.concat_ws("\u0000", _text(), _path(docs)))


def candidates(docs: DataFrame) -> DataFrame:
    """key, doc_id, path, place (of the word in the text), value, and the words around it."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _path(docs).alias("path"), row_key(docs).alias("key"), _text().alias("text"))
    # Most texts hold no candidate at all; one pass of an expression spares them the split.
    held = held.where(F.col("text").rlike(_CANDIDATE) | F.col("text").rlike(_HAS_NAME) | F.col("text").rlike(_USERINFO))
    held = held.withColumns({"words": F.split("text", _SPACE), "keys": F.contains("text", F.lit("PRIVATE"))}).drop("text")
    get = lambda at: F.coalesce(F.get("words", at), F.lit(""))
    context = lambda at: F.concat_ws(" ", get(at - 2), get(at - 1), get(at))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: get(k).rlike(_CANDIDATE) | get(k).rlike(_USERINFO) | context(k).rlike(_NAMED))
    # Places that open and close private keys' bodies; few texts have any.
    last = lambda ends: F.array_max(F.filter(ends, lambda k: k < F.col("at")))
    body = F.when(F.size("opens") > 0, F.coalesce(last("opens") > F.coalesce(last("closes"), F.lit(-1)), F.lit(False))).otherwise(False)
    ends = lambda has: F.when(F.col("keys"), F.filter(F.sequence(F.lit(0), F.size("words") - 1), has)).otherwise(F.array().cast("array<int>"))
    opens, closes = ends(lambda k: F.concat_ws(" ", get(k - 1), get(k)).rlike(_OPENS)), ends(lambda k: get(k).rlike(_CLOSES))
    rows = held.withColumns({"opens": opens, "closes": closes, "at": F.explode(places)}).withColumn("in_key", body)
    word = lambda shift: get(F.col("at") + shift)
    own, next_word = word(0), word(1)
    before = [word(-k) for k in (1, 2, 3)]
    runs = F.regexp_extract_all(own, F.lit(_CANDIDATE), F.lit(0))
    inner = F.regexp_extract_all(own, F.lit(_USERINFO), F.lit(1))
    runs = F.filter(runs, lambda r: ~F.exists(inner, lambda v: r.startswith(F.concat(v, F.lit("@")))))  # the password without its host
    named = F.filter(F.regexp_extract_all(context(F.col("at")), F.lit(_NAMED), F.lit(1)), lambda v: F.contains(own, v))
    return rows.select(
        "key", "doc_id", "path", F.col("at").cast("long").alias("place"), F.explode(F.array_distinct(F.concat(runs, named, inner))).alias("value"), own.alias("word"), *(b.alias(f"before{k}") for k, b in enumerate(before, 1)), next_word.alias("after"), "in_key",
    )


def dictionary(docs: DataFrame) -> DataFrame:
    """(part, uses) of words of three and more Latin letters that stand DICTIONARY_COUNT times or more in all texts."""
    words = docs.select(F.explode(F.split(F.lower(_text()), "[^a-z]+")).alias("part")).where("length(part) >= 3")
    return words.groupBy("part").agg(F.count("*").alias("uses")).where(F.col("uses") >= DICTIONARY_COUNT)


def transitions(words: DataFrame) -> Column:
    """An array, by pair of letters, of the negative logarithm of the second's share after the first in the dictionary."""
    at = words.select("uses", "part", F.explode(F.sequence(F.lit(1), F.length("part") - 1)).alias("k"))
    counts = dict(at.groupBy(F.expr("substring(part, k, 2)")).agg(F.sum("uses")).collect())  # 26 x 26 at most
    letters = "abcdefghijklmnopqrstuvwxyz"
    costs = []
    for a in letters:
        total = sum(counts.get(a + b, 0) for b in letters) + len(letters)
        costs += [math.log(total / (counts.get(a + b, 0) + 1)) for b in letters]
    return F.array(*map(F.lit, costs))


def findings(docs: DataFrame) -> DataFrame:
    """Candidates with FEATURES and, where the strict rule is sure, a label."""
    return featured(saved(candidates(docs), "candidates"), saved(dictionary(docs), "dictionary"))


def planted(docs: DataFrame, words: DataFrame, phrases: tuple = PLANTS) -> DataFrame:
    """Findings with FEATURES and label among phrases, each put between words of each of PLANTED_TEXTS texts."""
    full = docs.select(_text().alias("text"), _path(docs).alias("source")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # Hashes are ordered first, without their texts; then the texts of the least ones are read.
    full = full.withColumn("order_", F.xxhash64("text", "source"))
    least = saved(full.select("order_").distinct().orderBy("order_").limit(PLANTED_TEXTS), "least-hashes")
    some = saved(full.join(F.broadcast(least), "order_").select("text", "source").distinct(), "texts")
    plants = [F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), F.lit(wording.replace("{{", "{").replace("}}", "}")).alias("wording"), F.lit(kind).alias("kind")) for k, (label, wording, kind) in enumerate((n, w, kind) for n, w, kinds in phrases for kind in kinds)]
    rows = some.select("source", F.split("text", _SPACE).alias("words"), F.sha2("text", 256).alias("h"), F.explode(F.array(*plants)).alias("plant")).select("source", "words", "h", "plant.*")
    rows = rows.withColumn("h", F.sha2(F.concat("h", F.col("k").cast("string")), 256)).withColumn("at", F.pmod(F.xxhash64("h"), F.size("words")).cast("int"))
    part = lambda n, k=1: F.substring("h", k, n)
    digits = lambda n, k=1: F.substring(F.translate("h", "abcdef", "123456"), k, n)
    letters = F.translate(F.base64(F.unhex("h")), "+/=", "xyz")
    word = lambda k: F.regexp_replace(F.get("words", F.pmod(F.xxhash64("h", F.lit(k)), F.size("words")).cast("int")), r"[^\p{L}]", "")
    name = F.concat(F.lower(word(1)), digits(2))
    line = F.substring(F.translate(F.base64(F.unhex(F.concat("h", F.sha2(F.concat("h", F.lit("2")), 256)))), "=", "x"), 1, 64)
    site = F.concat(F.lit("//www."), F.lower(word(1)), F.lit(".example/"))
    values = {
        "line64": line, "web_token": F.concat(F.lit("eyJ"), F.translate(F.substring(line, 1, 17), "+/", "-_"), F.lit(".eyJ"), F.translate(F.substring(line, 20, 27), "+/", "-_"), F.lit("."), F.substring(letters, 1, 40)),
        "hook": F.concat(F.lit("//hooks."), F.lower(word(1)), F.lit(".example/services/T0"), digits(7), F.lit("/B0"), digits(7, 8), F.lit("/"), F.substring(letters, 1, 24)),
        "page": F.concat(site, F.lower(word(2)), digits(3)), "commit_page": F.concat(site, F.lower(word(2)), F.lit("/commit/"), part(40)),
        "call": F.concat(F.lower(word(1)), F.lit("."), F.lower(word(2)), F.lit("("), F.lower(word(3))), "attribute": F.concat(F.lower(word(1)), F.lit("."), F.lower(word(2)), F.lit("_"), F.lower(word(3))),
        "hex18": part(18), "hex32": part(32), "hex40": part(40), "hex64": part(64), "base64": F.substring(F.base64(F.unhex("h")), 1, 40), "mixed": F.substring(letters, 1, 24),
        "amazon": F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))), "github": F.concat(F.lit("ghp_"), F.substring(letters, 1, 36)), "stripe": F.concat(F.lit("sk_live_"), F.substring(letters, 1, 24)),
        "phrase": F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3))), "marked": F.concat(word(1), F.lit("!"), word(2), F.lit("#"), digits(2)),
        "digits16": digits(16), "digits10": digits(10), "mail": F.concat(name, F.lit("@mail"), digits(1, 9), F.lit(".example.com")), "host": F.concat(F.lit("1"), digits(2), F.lit(".1"), digits(1, 3), F.lit(".1"), digits(2, 4), F.lit("."), digits(2, 6)),
        "date": F.concat(F.lit("20"), digits(2), F.lit("-0"), digits(1, 3), F.lit("-1"), digits(1, 4)), "link": F.concat(F.lit("https://www."), F.lower(word(1)), F.lit(".example/"), F.lower(word(2)), digits(3)), "file": F.concat(F.lit("src/"), F.lower(word(1)), F.lit("/"), F.lower(word(2)), F.lit("_v"), digits(2), F.lit(".txt")),
        "release": F.concat(F.lower(word(1)), F.lit("-"), digits(1), F.lit("."), digits(2, 2), F.lit("."), digits(1, 4)), "word_number": F.concat(word(1), digits(4)), "joined": F.concat(word(1), F.lit("."), word(2), digits(1)), "phone": F.concat(digits(3), F.lit("-555-"), digits(4, 4)),
        "uuid": F.concat_ws("-", part(8), part(4, 9), part(4, 13), part(4, 17), part(12, 21)), "stand_in": F.get(F.array(*map(F.lit, STAND_INS)), F.pmod(F.xxhash64("h"), F.lit(len(STAND_INS))).cast("int")), "plain_word": F.lower(word(1)),
    }
    value = F.lit(None).cast("string")
    for kind, made in values.items():
        value = F.when(F.col("kind") == kind, made).otherwise(value)
    near = lambda start: F.concat_ws(" ", F.slice("words", start, F.lit(PLANTED_WORDS)))
    rows = rows.withColumn("planted", value).withColumn("text", F.concat_ws(" ", near(F.greatest(F.lit(1), F.col("at") - PLANTED_WORDS + 1)), F.replace("wording", F.lit("{v}"), "planted"), near(F.col("at") + 1)))
    rows = rows.select(F.lit(0).alias("doc_id"), "text", "source", "planted", "label").repartition(docs.sparkSession.sparkContext.defaultParallelism)  # else one task has them all
    rows = saved(rows, "planted-texts")
    truth = rows.select(row_key(rows).alias("key"), F.col("planted").alias("value"), "label").distinct()
    found = featured(saved(candidates(rows), "planted-candidates"), words).drop("label")
    return found.join(truth, ["key", "value"])


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with FEATURES and the strict rule's label; words: the dictionary."""
    parts = found.select("value").distinct().select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("part")).where("length(part) >= 3")
    parts = saved(parts, "parts")  # written, so that Spark knows its size
    known = parts.join(words, "part").groupBy("value").agg(F.sum(F.length("part")).alias("covered"))
    known = saved(known, "covered")  # a written table, so that Spark may split a value that stands in many texts
    n, value, word = F.length("value"), F.col("value"), F.col("word")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    # The word up to the value, and of it what follows the last separator: the value's own name.
    lead = F.when(F.contains(word, value), F.expr("substring_index(word, value, 1)")).otherwise("")
    named = F.regexp_extract(lead, r"[^,;&?{}]*$", 0)
    pairs = F.regexp_extract_all(F.lower(value), F.lit("(?=([a-z][a-z]))"), F.lit(1))
    cost = transitions(words)
    of_pair = lambda p: F.get(cost, F.ascii(p) * 26 + F.ascii(F.substring(p, 2, 1)) - 97 * 27)
    unlikely = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + of_pair(p)) / F.greatest(F.lit(1), F.size(pairs))
    assigned = (F.col("before1").rlike("[=:>]$") & lead.rlike(r"^\\?[\"'`]?$")) | lead.rlike(r"[=:>]\\?[\"'`]?$")
    near = F.concat_ws(" ", "before3", "before2", "before1", named)
    rows = found.join(known, "value", "left").select(
        "key", "doc_id", "place", "value",
        n.cast("double").alias("value_length"), (F.regexp_count(value, F.lit(_CHANGES)) / n).alias("changes"), unlikely.alias("transitions"),
        flag(value.rlike(_NUMBER)).alias("number"), flag(value.rlike(_ADDRESS)).alias("address"), flag(value.rlike(_PLACEHOLDER)).alias("placeholder"), flag(value.rlike(_KNOWN)).alias("known_prefix"),
        share("[0-9]").alias("digit_share"), share("[A-Z]").alias("upper_share"), share("[aeiouAEIOU]").alias("vowel_share"),
        (F.size(F.array_distinct(F.split(value, ""))) / n).alias("distinct_share"), share("[^A-Za-z0-9]").alias("mark_share"), flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex"), (F.coalesce("covered", F.lit(0)) / n).alias("dictionary"),
        F.length("path").cast("double").alias("path_length"), F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"), flag(F.col("path").rlike(_TEST_PATH)).alias("path_test"),
        flag(F.concat_ws(" ", "before2", "before1").rlike(_NAMES)).alias("named_before"), flag(near.rlike(_NAMES)).alias("named_near"), flag(assigned).alias("assigned"), flag(lead.rlike(r"[\"'`]$")).alias("quoted"),
        F.length("before1").cast("double").alias("word_before"), F.length("after").cast("double").alias("word_after"),
        flag(lead.rlike(r"://[^/:@]*:$") & F.contains(word, F.concat(value, F.lit("@")))).alias("userinfo"), flag(F.col("in_key")).alias("private_key"), F.regexp_count(value, F.lit(_RUN)).cast("double").alias("long_runs"),
        flag(value.rlike(_CODE)).alias("code"), flag(F.concat_ws(" ", "before2", "before1").rlike(_SAID)).alias("said"),
    )
    mixed = (F.col("digit_share") > 0.1) & (F.col("digit_share") < 1) & (n >= 16)
    label = F.when((F.col("named_near") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & mixed, 1).when(value.rlike(_NUMBER) | value.rlike(_ADDRESS) | (F.col("dictionary") >= 0.5), 0)
    return saved(rows.withColumn("label", label.cast("int")), "findings")


def scored(found: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Findings with `probability`. labelled: findings with FEATURES and label; else the sure ones of `found`."""
    pool = (found if labelled is None else labelled).where("label in (0, 1)")
    parts = [pool.where(F.col("label") == k).orderBy(F.xxhash64("key", "place", "value"), "key", "place").limit(MAX_LABELLED) for k in (0, 1)]
    training = saved(parts[0].unionByName(parts[1]).select("label", *FEATURES), "labelled")
    if {r.label for r in training.select("label").distinct().collect()} != {0, 1}:
        return found.withColumn("probability", F.coalesce(F.col("label").cast("double"), F.lit(0.5)))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector_", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol="label", featuresCol="vector_", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="p_", rawPredictionCol="raw_", predictionCol="prediction_").fit(vectors.transform(training))
    return forest.transform(vectors.transform(found)).withColumn("probability", vector_to_array("p_")[1]).drop("vector_", "raw_", "p_", "prediction_")


def secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """A row for each finding: key, doc_id, place, value, FEATURES, label (the strict rule's), probability, is_secret."""
    words = saved(dictionary(docs), "dictionary")
    found = featured(saved(candidates(docs), "candidates"), words)
    return scored(found, planted(docs, words) if labelled is None else labelled).withColumn("is_secret", F.col("probability") >= threshold)


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all of them and with the same columns; secrets in text read REDACTED wherever they stand alone
    (no letter or digit of ASCII beside them), and n_chars follows.

    Texts without a secret, nulls among them, stay as they are, n_chars included; repeated
    rows are redacted alike.
    """
    key, found = fresh(docs, "key_"), fresh(docs, "values_")
    bad = secrets(docs, labelled).where("is_secret").groupBy("key").agg(F.collect_set("value").alias(found)).withColumnRenamed("key", key)
    # Longer values first, so that one inside another leaves nothing behind.
    order = F.array_sort(found, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    rows = docs.withColumn(key, row_key(docs)).join(saved(bad, "secrets"), key, "left")
    alone = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.aggregate(order, F.col("text"), lambda t, v: F.regexp_replace(t, alone(v), F.lit(REDACTED))))
    chars = F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return rows.select(*(text.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", F.sha2("value", 256).alias("value_sha256"), *FEATURES, "probability", "is_secret")
