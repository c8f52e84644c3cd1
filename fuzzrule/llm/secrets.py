"""Secret scan with a random forest that removes false positives (native:
SQL functions and the JVM's forest only).

Candidates are runs of 16 or more key characters with a digit, from whole
texts, with the text between them as context.  Each is described by length,
character classes and transitions, entropy, the share of its letters that are
dictionary words, its path and its neighbouring words; a forest trained on
labelled findings gives the probability that it is a secret.

The dictionary is counted over all documents (words in a given share of
them) and joined by the letter runs of distinct candidates; only words with
their counts and candidates are shuffled, never texts.

No given table holds labelled findings; the query trains on findings made
from templates (``template_findings``) by the operator's own extraction, so
any labelled texts can take their place.

Defined cases: null and empty texts have no candidates; rows that repeat an
id, and equal candidates in one text, are reported one by one (``nth`` counts
in the text); a null path is an empty one; labelled findings of one class
give that class's share as probability; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzrule.llm.common import LOWER, UPPER, read_table, written

# fixed values: the candidate pattern and the word lists of the features
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}"
DIGITS = "0123456789"
KEY_WORDS = "key|token|secret|passw|pwd|auth|credential|bearer|private|access"
HASH_WORDS = "commit|sha|md5|hash|checksum|digest|revision|etag|integrity|uuid|guid"
NUMBER_WORDS = "order|invoice|card|account|phone|isbn|tracking|ticket|serial|version"
SAMPLE_WORDS = "example|sample|dummy|placeholder|changeme|your|test|fake|xxxx"
PATH_WORDS = "test|example|fixture|sample|mock|vendor|docs"
COMMON_WORDS = (
    "about access account admin after also and any api app are auth back base been before bin build but can change class client "
    "code com common config const content copy count create data date default delete dev docs each end error example file final "
    "first folder for form from get has have header home host html http https image images import index info input item key last "
    "lib line link list local log login long main make max message min mode model more name net new next node not now number "
    "object off one only open option org other out output page pass password path plugin port post private prod public python "
    "query read release request response result root run sample secret server service session set setting share site size some "
    "source src start state static status string style system table tag task temp template test text that the then this time title "
    "token tool type update url use user usr util value var version view web when where which will with word work write www year "
    "you your").split()

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_signs", "f_hex", "f_turns", "f_vowel_turns", "f_distinct", "f_entropy",
            "f_words", "f_slashes", "f_key_word", "f_hash_word", "f_number_word", "f_sample_word", "f_assigned", "f_quoted", "f_url",
            "f_path", "f_only_digits", "f_uuid"]


def find_candidates(docs: DataFrame, id_col: str, text_col: str, path: Column | None = None) -> DataFrame:
    """(id, row, nth, start, secret, before, after, path) of each candidate."""
    text = docs.where(F.col(text_col).rlike("[0-9]")).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"),
        F.coalesce(path if path is not None else F.lit(""), F.lit("")).alias("path"))
    found = (text.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
             .where(F.size("found") > 0).withColumn("gaps", F.split("text", CANDIDATE, -1)))
    each = found.select("id", "row", "path", "gaps", F.posexplode("found").alias("nth", "secret")).select(
        "id", "row", "path", "nth", "secret", F.expr("length(gaps[nth])").alias("gap"),
        F.expr("right(gaps[nth], 80)").alias("before"), F.expr("left(gaps[nth + 1], 40)").alias("after"))
    # characters before it: the gaps and candidates so far.  Equal rows of one
    # id share a window; their equal nth are divided out.
    start = F.expr("cast((sum(gap + length(secret)) over (partition by id, row order by nth range unbounded preceding)) "
                   "/ count(1) over (partition by id, row, nth) as long) - length(secret)")
    return each.withColumn("start", start).drop("gap")


def dictionary(docs: DataFrame, text_col: str, share: float = 0.002, least: int = 5) -> DataFrame:
    """Words (3 to 12 letters) in at least ``share`` of all documents, with the
    fixed list of common ones."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), "[^a-z]+"))).alias("word"))
    counts = words.where("length(word) between 3 and 12").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    most = max(least, int(share * docs.count()))
    fixed = docs.sparkSession.createDataFrame([(w,) for w in COMMON_WORDS if len(w) >= 3], "word string")
    return written(counts.where(F.col("n") >= most).select("word").unionAll(fixed).distinct(), "dictionary")


def _covered(cands: DataFrame, words: DataFrame) -> DataFrame:
    """(of, f_words): the share of each distinct candidate's characters that lie
    in dictionary words (its runs of letters, camel case split); ``of`` is its
    digest, and candidates without such a word have no row."""
    runs = F.regexp_extract_all(F.col("secret"), F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))
    # a run goes with its candidate's digest, not with the candidate: a long one has many runs
    # (made before the runs are spread, or it would be made anew for each of them)
    each = cands.select("secret").distinct().select(_digest("secret").alias("of"), F.length("secret").alias("n"), runs.alias("runs"))
    parts = each.select("of", "n", F.explode("runs").alias("run"))
    parts = parts.groupBy("of", "n", F.lower("run").alias("run")).agg(F.sum(F.length("run")).alias("chars"))
    return (parts.join(words.withColumnRenamed("word", "run"), "run").groupBy("of")
            .agg((F.sum("chars") / F.max("n")).alias("f_words")))


def _digest(col: str) -> Column:
    return F.unhex(F.md5(F.col(col).cast("binary")))


def with_features(cands: DataFrame, words: DataFrame) -> DataFrame:
    s, n = F.col("secret"), F.length("secret")
    share = lambda chars: (n - F.length(F.translate(s, chars, ""))) / n
    near = F.lower(F.concat_ws(" ", "before", "after"))
    last = F.lower(F.expr("right(before, 40)"))
    flag = lambda c: c.cast("double")
    classes = F.translate(s, LOWER + UPPER + DIGITS + "+/_-=", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5)
    sounds = F.translate(F.lower(s), LOWER + DIGITS, "vcccvcccvcccccvcccccvccccc" + "0" * 10)
    turns = lambda c: (F.length(F.regexp_replace(c, r"(.)\1*", "$1")) - 1) / n
    entropy = F.expr("aggregate(array_distinct(split(secret, '')), 0D, (e, x) -> e - (length(secret) - length(replace(secret, x, '')))"
                     " / length(secret) * log2((length(secret) - length(replace(secret, x, ''))) / length(secret)))")
    out = (cands.withColumn("f_length", F.log(n.cast("double"))).withColumn("f_digits", share(DIGITS))
           .withColumn("f_upper", share(UPPER)).withColumn("f_lower", share(LOWER)).withColumn("f_signs", share("+/_-="))
           .withColumn("f_hex", flag(F.lower(s).rlike("^[0-9a-f]+$"))).withColumn("f_turns", turns(classes))
           .withColumn("f_vowel_turns", turns(sounds))
           .withColumn("f_distinct", F.size(F.array_distinct(F.split(s, ""))) / F.least(n, F.lit(64)))
           .withColumn("f_entropy", entropy).withColumn("f_slashes", share("/") * n)
           .withColumn("f_key_word", flag(last.rlike(KEY_WORDS))).withColumn("f_hash_word", flag(last.rlike(HASH_WORDS)))
           .withColumn("f_number_word", flag(last.rlike(NUMBER_WORDS))).withColumn("f_sample_word", flag(F.concat(near, F.lower(s)).rlike(SAMPLE_WORDS)))
           .withColumn("f_assigned", flag(F.col("before").rlike(r"[=:]\s*[\"']?$"))).withColumn("f_quoted", flag(F.col("before").rlike("[\"']$")))
           .withColumn("f_url", flag(F.col("before").rlike(r"(https?://|www\.)\S*$"))).withColumn("f_path", flag(F.lower("path").rlike(PATH_WORDS)))
           .withColumn("f_only_digits", flag(s.rlike("^[0-9\\-]+$")))
           .withColumn("f_uuid", flag(F.lower(s).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))))
    covered = written(_covered(cands, words), "covered")
    return (out.withColumn("of", _digest("secret")).join(covered, "of", "left").drop("of")
            .withColumn("f_words", F.coalesce("f_words", F.lit(0.0))))


# Templates of labelled findings; {x} stands for hex digits of a hash, {d} for
# decimal ones, {b} for base-64 characters.  Fixed values.
TEMPLATES = [
    (1, 'token = "{x40}"'), (1, "api_key: {x32}"), (1, "secret={b40}"), (1, "password = '{b20}9z'"), (1, "Authorization: Bearer {b44}"),
    (1, "aws_access_key_id = AKIA{u16}"), (1, "export GITHUB_TOKEN=ghp_{b36}"), (1, '"client_secret": "{b32}"'),
    (1, "private key {x64}"), (1, "the access token is {x40} and"), (1, "sk_live_{b24}"), (1, "auth_token: '{x48}',"),
    (0, "commit {x40}"), (0, "sha256 checksum {x64}"), (0, "id {x8}-{x4}-{x4}-{x4}-{x12}"), (0, "card {d16}"), (0, "paid with {d16} and"),
    (0, "md5: {x32}"), (0, "order number {d18}"), (0, "https://www.example.com/static/images/{d8}/page-{d4}-title"),
    (0, "see /usr/lib/python3/site-packages/version-{d2}"), (0, 'password = "your-password-here-{d2}"'), (0, "token = example-token-value-{d4}"),
    (0, "user_name_update_time_{d2}"), (0, "version-{d4}-release-notes-{d2}"), (0, "tel {d4}-{d4}-{d4}-{d4}"), (0, "date 2020-{d2}-{d2}-{d8}"),
    (0, "api_key = xxxxxxxxxxxxxxxxxxxx{d2}"), (0, "etag {x32}"), (0, "he wrote {d20} there"),
]


# where findings were made: real ones mostly in sources, others mostly in tests and documents
PATHS = {1: ("src/app.py", "deploy/prod.env", "conf/service.yaml", "lib/client.js", "tests/test_client.py"),
         0: ("tests/fixtures/data.py", "docs/readme.md", "src/app.py", "vendor/lib/mock.js")}


def template_findings(spark: SparkSession, per_template: int = 40) -> DataFrame:
    """(id, text, path, label): labelled texts, one finding each; a list of
    fixed size, made from hashes of its numbers."""
    around = ("", "it says ", "von der ", "x.\n", "and so on | ")
    rows = []
    for t, (label, template) in enumerate(TEMPLATES):
        for k in range(per_template):
            def fill(m, t=t, k=k):
                raw = b"".join(hashlib.sha256(f"{t}/{k}/{m.start()}/{i}".encode()).digest() for i in (0, 1))
                kind, n = m[1], int(m[2])
                noise = {"x": raw.hex(), "u": raw.hex().upper(), "d": str(int.from_bytes(raw, "big"))[1:],
                         "b": re.sub(r"[+/=]", "", base64.b64encode(raw).decode())}[kind]
                return noise[:n]
            text = re.sub(r"\{([xudb])(\d+)\}", fill, template)
            rows.append((t * 1000 + k, f"{around[k % 5]}{text} the end", PATHS[label][(t + k) % len(PATHS[label])], label))
    return spark.createDataFrame(rows, "id long, text string, path string, label int")


def train(findings: DataFrame, words: DataFrame, trees: int = 40, depth: int = 7, seed: int = 5):
    """A forest on labelled findings (id, text, path, label); their number is
    the trainer's choice.  One class alone: its share as a constant."""
    cands = find_candidates(findings, "id", "text", F.col("path"))
    rows = with_features(cands, words).join(findings.select("id", "label"), "id")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("id", "nth", "features", F.col("label").cast("double"))
    rows = written(rows.orderBy("id", "nth"), "findings")
    seen = [r[0] for r in rows.select("label").distinct().collect()]
    if len(seen) < 2:
        return float(seen[0]) if seen else 0.0
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", minInstancesPerNode=2).fit(rows)


def scan_secrets(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None,
                 **how) -> DataFrame:
    """Every candidate of ``docs`` with the probability that it is a secret."""
    words = dictionary(docs, text_col)
    model = train(findings, words, **how)
    cands = written(find_candidates(docs, id_col, text_col, path), "candidates")
    rows = with_features(cands, words)
    if isinstance(model, float):
        return rows.withColumn("probability", F.lit(model))
    rows = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return rows.withColumn("probability", F.element_at(vector_to_array("probability"), 2))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents, their source as path; the secret itself
    only as a digest."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"), template_findings(spark), path=F.col("source"))
    return found.select(F.col("id").alias("doc_id"), "nth", "start", F.length("secret").alias("length"),
                        F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"),
                        F.round("probability", 6).alias("probability"), (F.col("probability") >= 0.5).alias("is_secret"))
