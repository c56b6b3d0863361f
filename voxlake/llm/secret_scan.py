"""Secret scanning with a random forest against false positives. DataFrame functions only.

Candidates are long tokens with a digit. The forest sees their length, character
transitions, dictionary coverage, path and neighbouring words, and is trained from
labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from voxlake.llm.common import SPACES
from voxlake.session import small_side, write_table

# What a candidate is, and words beside one.
# Looked at where a run of such characters begins and nowhere else, so that long runs
# take no longer than short ones.
_RUN = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_RUN})(?=[A-Za-z+/_=-]*+[0-9]){_RUN}{{16,}}+"
KEY_WORDS = (
    "access", "api", "apikey", "auth", "authorization", "bearer", "credential", "credentials",
    "key", "passwd", "password", "private", "pwd", "secret", "token",
)
PLACEHOLDER_WORDS = ("changeme", "dummy", "example", "fake", "placeholder", "sample", "test", "xxx", "your")
HASH_WORDS = ("blob", "checksum", "commit", "digest", "etag", "fingerprint", "hash", "md5", "rev", "sha", "sha1", "sha256", "version")
# What a candidate starts with when it is assigned to a name without blanks.
NAME = "^.*=(?=[^=])"
# Characters of a neighbouring word that count, those next to the candidate.
NEAR = 200
# Findings of each label that the forest is trained on, in expectation, without their copies.
TRAIN_FINDINGS = 4_000
TREES, DEPTH, SEED = 40, 7, 7
# A letter run is a word when the corpus has it so often outside candidates.
DICTIONARY_TIMES = 3

FEATURES = [
    "length", "distinct_share", "digit_share", "upper_share", "hex", "switches", "case_switches",
    "transition", "coverage", "in_path", "slashes", "dots", "quoted", "assigned",
    "key_near", "placeholder_near", "hash_near",
]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, place, before, after, nth, front, value, word): every candidate of every word.

    `place` is the word's number in its text, `before` its three predecessors, `nth`
    the candidate's number in its word. `front` is the word's own text ahead of the
    candidate, from the one before it on, with a name and `=` that the candidate
    starts with; `word` reads on to the next one. `value` is the candidate without
    that name, or with it where the rest is too short for a candidate.
    """
    words = F.split("text", SPACES)

    def described(w: Column, i: Column) -> Column:
        return F.when(w.rlike(CANDIDATE), F.struct(
            i.alias("place"), w.alias("word"),
            F.transform(
                F.slice(F.col("words"), F.greatest(F.lit(1), i - 2), F.least(i, F.lit(3))),
                lambda x: F.right(x, F.lit(NEAR)),
            ).alias("before"),
            F.left(F.get(F.col("words"), i + 1), F.lit(NEAR)).alias("after"),
        ))

    def told(hit: Column, k: Column) -> Column:
        last = F.when(k > 0, F.regexp_replace(F.get(F.col("hits"), k - 1), NAME, "")).otherwise("")
        ahead = F.concat(last, F.get(F.col("gaps"), k))
        name = F.regexp_extract(hit, NAME, 0)
        rest = F.regexp_replace(hit, NAME, "")
        return F.struct(
            k.alias("nth"), F.concat(ahead, name).alias("front"),
            F.when(rest.rlike(CANDIDATE), rest).otherwise(hit).alias("value"),
            F.concat(ahead, hit, F.get(F.col("gaps"), k + 1)).alias("word"),
        )

    found = F.filter(F.transform("words", described), lambda x: x.isNotNull())
    return (
        docs.where(F.col("text").rlike(CANDIDATE))
        .select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
        .select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")
        .withColumn("before", F.coalesce("before", F.array().cast("array<string>")))
        .withColumn("after", F.coalesce("after", F.lit("")))
        .select(
            "doc_id", "place", "before", "after",
            F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)).alias("hits"),
            F.split("word", CANDIDATE).alias("gaps"),
        )
        .select("doc_id", "place", "before", "after", F.explode(F.transform("hits", told)).alias("f"))
        .select("doc_id", "place", "before", "after", "f.*")
    )


def _front() -> Column:
    """The word's own text ahead of a candidate, as much of it as counts."""
    return F.right("front", F.lit(NEAR))


def is_named() -> Column:
    """Whether a finding is assigned to a name like a key: its label."""
    beside = F.concat_ws(" ", "before", _front())
    return beside.rlike(rf"(?i)(?:^|[^a-z])(?:{'|'.join(KEY_WORDS)})\W*(?:[=:]|:=|=>)\W*$").cast("double")


def drawn(found: DataFrame, findings: int) -> DataFrame:
    """About `findings` of `found` with either label, all where there are no more, picked by a hash."""
    label = is_named()
    sizes = {r["label"]: r["count"] for r in found.groupBy(label.alias("label")).count().collect()}
    share = F.lit(0.0)
    for kind, n in sizes.items():
        share = F.when(label == kind, F.lit(findings / n)).otherwise(share)
    part = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "place", "nth"), F.lit(2**40)) / 2**40
    return found.where(part < share)


def labelled_findings(found: DataFrame) -> DataFrame:
    """Findings with `label`: what they are, and the same values where they are none.

    A value that is assigned to a name like a key is a secret, any other is not. As
    a lone value cannot tell the two apart, each labelled secret is also placed
    where such a value is harmless (a path, a named digest, a placeholder), and each
    harmless one stays what it is.
    """
    real = found.withColumn("label", is_named())
    secret = real.where("label = 1")
    words = F.array(*map(F.lit, HASH_WORDS))
    turn = F.pmod(F.xxhash64("doc_id", "place", "nth"), F.lit(len(HASH_WORDS)))
    path = secret.withColumn("front", F.lit("/objects/")).withColumn("word", F.concat("front", "value", F.lit(".bin")))
    digest = secret.withColumn("front", F.lit("")).withColumn("word", F.col("value")).withColumn(
        "before", F.array(F.lit("the"), F.get(words, turn))
    )
    stand_in = secret.withColumn(
        "value", F.concat_ws("_", F.lit("your_token_here"), "place", "nth")
    ).withColumn("word", F.concat("front", "value", F.lit('"')))
    other = secret.withColumn("before", F.array(F.lit("api_key"), F.lit(":")))
    harmless = [
        t.withColumn("label", F.lit(0.0)) for t in (path, digest.withColumn("after", F.lit("")), stand_in)
    ]
    out = real.unionByName(other)
    for t in harmless:
        out = out.unionByName(t)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the whole corpus: lower case, no punctuation around, no digits.

    Occurrences are summed up where they are read; only distinct words are cleaned.
    """
    raw = docs.select(F.explode(F.split("text", SPACES)).alias("raw")).groupBy("raw").count()
    clean = F.lower(F.regexp_replace("raw", r"^\W++|(?<!\W)\W++$", ""))
    return write_table(
        raw.where(~F.col("raw").rlike("[0-9]")).groupBy(clean.alias("word"))
        .agg(F.sum("count").alias("n")), "words",
    )


def dictionary(found: DataFrame, words: DataFrame) -> DataFrame:
    """(piece): letter runs of candidates that are words of the corpus."""
    pieces = write_table(
        found.select(F.explode(F.expr(r"regexp_extract_all(value, '[A-Za-z]{3,}', 0)")).alias("piece"))
        .select(F.lower("piece").alias("word")).distinct(), "pieces",
    )
    known = words.where(F.col("n") >= DICTIONARY_TIMES).join(small_side(pieces), "word", "left_semi")
    return write_table(known.select(F.col("word").alias("piece")), "dictionary")


def transitions(words: DataFrame) -> DataFrame:
    """(pair, surprise): minus log2 of the chance of a character after another in the corpus.

    Characters other than a-z and 0-9 are one, so there are at most 1,369 pairs.
    """
    pairs = (
        words.where(F.length("word") > 1)
        .select(F.explode(_pairs(F.col("word"))).alias("pair"), "n")
        .groupBy("pair").agg(F.sum("n").alias("n"))
    )
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("all"))
    return write_table(
        pairs.withColumn("first", F.substring("pair", 1, 1)).join(firsts, "first")
        .select("pair", (-F.log2((F.col("n") + 0.5) / (F.col("all") + 18.5))).alias("surprise")),
        "transitions",
    )


def _pairs(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]", "-")
    return F.regexp_extract_all(plain, F.lit("(?=(..))"), F.lit(1))


def _near(column: Column, words: tuple[str, ...]) -> Column:
    return F.lower(column).rlike(rf"(?:^|[^a-z])(?:{'|'.join(words)})(?:$|[^a-z])").cast("double")


def features(found: DataFrame, known: DataFrame, surprise: DataFrame) -> DataFrame:
    """`found` with the features, in one vector `features`."""
    n = F.length("value")
    letters = F.expr(r"regexp_extract_all(lower(value), '[a-z]{3,}', 0)")
    numbered = write_table(found.withColumn("digest", F.sha2("value", 256)), "findings")
    # Values repeat; each is looked up once, and only its digest goes with its pieces.
    values = write_table(numbered.groupBy("digest").agg(F.first("value").alias("value")), "values")
    rare = (
        values.select("digest", F.explode(_pairs(F.col("value"))).alias("pair"))
        .join(small_side(surprise), "pair", "left")
        .groupBy("digest").agg(F.avg(F.coalesce("surprise", F.lit(12.0))).alias("transition"))
    )
    covered = (
        values.select("digest", F.explode(letters).alias("piece"))
        .join(small_side(known), "piece").groupBy("digest")
        .agg(F.sum(F.length("piece")).alias("word_letters"))
    )
    looked_up = write_table(
        rare.join(covered, "digest", "left")
        .select("digest", "transition", F.coalesce("word_letters", F.lit(0)).alias("word_letters")), "looked_up",
    )
    beside = F.concat_ws(" ", "before", _front(), "after")
    described = numbered.join(looked_up, "digest").select(
        "*",
        (F.col("word_letters") / n).alias("coverage"),
        n.cast("double").alias("length"),
        (F.size(F.array_distinct(F.split("value", ""))) / n).alias("distinct_share"),
        (F.regexp_count("value", F.lit("[0-9]")) / n).alias("digit_share"),
        (F.regexp_count("value", F.lit("[A-Z]")) / n).alias("upper_share"),
        F.col("value").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        (F.regexp_count("value", F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")) / n).alias("switches"),
        (F.regexp_count("value", F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / n).alias("case_switches"),
        F.col("word").rlike(r"^[a-zA-Z]+://|^(?:\.{0,2}/|[A-Za-z]:\\)|/[^/]+/").cast("double").alias("in_path"),
        F.regexp_count("word", F.lit(r"[/\\]")).cast("double").alias("slashes"),
        F.regexp_count("word", F.lit(r"\.")).cast("double").alias("dots"),
        F.col("word").rlike("""["'`]""").cast("double").alias("quoted"),
        F.concat_ws(" ", "before", _front())
        .rlike(r"""[=:]>?[\s"'`]*$""").cast("double").alias("assigned"),
        _near(beside, KEY_WORDS).alias("key_near"),
        _near(F.concat_ws(" ", beside, "word"), PLACEHOLDER_WORDS).alias("placeholder_near"),
        _near(beside, HASH_WORDS).alias("hash_near"),
    )
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(described)


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """The forest; the bounded sample lies in one partition, so that reruns agree."""
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED
    )
    order = ["doc_id", "place", "nth", "word", "label"]
    return forest.fit(labelled.select(*order, "features").repartition(1).sortWithinPartitions(*order))


def scan_secrets(docs: DataFrame, labels: DataFrame | None = None, findings: int = TRAIN_FINDINGS) -> DataFrame:
    """(doc_id, place, nth, length, value_sha256, score, secret) per candidate of `docs` (doc_id, text).

    `score` is the forest's share of votes for a secret, `secret` whether it is above
    a half. `labels` are labelled findings, with the columns of `candidates` and
    `label`; without them they are made from all candidates, of which about
    `findings` of each label are picked by a hash. Whole texts are read; a null or empty text has no candidates. Rows
    with null or equal ids are scanned one by one. When the labels know one class
    only, every candidate gets that class. No candidates give no rows; other columns
    are ignored.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    found = write_table(candidates(docs), "candidates")
    if labels is None:
        labels = labelled_findings(drawn(found, findings))
    words = word_counts(docs)
    known, surprise = dictionary(found, words), transitions(words)
    labelled = write_table(
        features(labels, known, surprise).select("doc_id", "place", "nth", "word", "label", "features"), "labelled"
    )
    classes = [r["label"] for r in labelled.select("label").distinct().collect()]
    ready = features(found, known, surprise)
    if len(classes) < 2:
        score = F.lit(classes[0] if classes else 0.0)
        scored = ready.withColumn("score", score)
    else:
        scored = train(labelled).transform(ready).withColumn(
            "score", vector_to_array("probability").getItem(1)
        )
    return scored.select(
        "doc_id", F.col("place").cast("long").alias("place"), "nth", F.col("length").cast("int").alias("length"),
        F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") > 0.5).alias("secret"),
    )
