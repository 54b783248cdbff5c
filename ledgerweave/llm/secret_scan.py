"""Secret scans: pattern candidates, then a random forest that removes false positives (native only).

A candidate is a run of at least 16 key characters with a digit, a run in a known key format (with or without a digit), or
the value, of four characters at least, that a secret-like name is given by ``=`` or ``:``. Its features are
length, known format, changes of character class, the mean log-probability of its letter pairs under the pair statistics of the
corpus's words, digit and distinct-character shares, the share of its characters in letter runs that are words of the corpus, path marks, dots, an at sign,
and the words beside it: fixed cues, and the log-odds of each neighbouring word as learned from the labelled findings. The forest is
Spark's own and is trained from labelled findings: a table of texts with one finding each and its label. ``sample_findings`` makes
such a table from rules for callers without one, with the corpus's common words around them; it has a fixed, documented number of rows. A fifth of the findings is
held out and sets the limit.

Cases: a null or empty text has no candidate; all candidates of a text are kept, repeated ones too; repeated rows
give repeated findings; an empty table gives an empty result; extra columns are not carried. Positions are in
code points. The key itself is not returned, only its digest.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.session import durable

#: Key formats that are told by their begin.
FORMAT = (
    r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|sk-[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]*)?|-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----)"
)
#: A secret-like name and its sign of assignment; bounded, as it is looked back for.
GIVEN = r"(?i:token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']?\s{0,3}(?::=|[=:])\s{0,3}[\"']?"
#: A run that is a name and its value is left to the last form, which takes the value only. In every form the cheapest test comes first.
CANDIDATE = (
    rf"(?<![A-Za-z0-9_/+=.-])(?=[A-Za-z_/+=.-]*[0-9])(?![A-Za-z_.-]{{0,30}}{GIVEN}[^\s\"'=:]{{4}})[A-Za-z0-9_/+=.-]{{16,}}"
    rf"|(?=[-Agxse])(?<![A-Za-z0-9]){FORMAT}"
    rf"|(?<=[\s\"'=:])(?=[^\s\"'=:][^\s\"']{{3}})(?<=[=:]\s{{0,3}}[\"']?)(?<={GIVEN})[^\s\"']{{4,}}"
)
CONTEXT = 40
#: Words that stand beside real keys, and words that stand beside look-alikes.
NAMING = r"(?i)(token|secret|passw|api.?key|access.?key|private.?key|credential|bearer|auth)"
HARMLESS = r"(?i)(example|sample|dummy|placeholder|commit|sha\d*|digest|checksum|uuid|guid|revision|build|version|etag|https?:|href|src|path|file)"
FEATURES = (
    "length", "changes", "pairs", "digits", "distinct", "known", "path_marks", "dots", "in_path", "at", "named", "harmless", "beside", "assigned", "hex", "upper", "format",
)
#: Log-probability of a letter pair where all 676 are alike.
EVEN = -math.log(26 * 26)


def may_match(text: Column) -> Column:
    """Whether a text can hold a candidate at all: a digit, a sign of assignment or the begin of a format. Most texts hold none and cost no more."""
    out = text.rlike("[0-9=:]")
    for begin in ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "sk-", "eyJ", "-----BEGIN "):
        out = out | F.contains(text, F.lit(begin))
    return out


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, nth, start, candidate, before, after: every match with 40 characters on either side.

    A match starts after the gaps up to it and the matches before it: a running sum over the matches of its row, one row each.
    """
    found = docs.where(may_match(F.col(text))).select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(doc_id).alias("doc_id"),
        F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)).alias("_found"),
        F.col(text).alias("_text"),
        *keep,
    ).where(F.size("_found") > 0)
    found = found.withColumn("_gaps", F.split("_text", CANDIDATE)).drop("_text")
    rows = F.transform(
        "_found",
        lambda c, i: F.struct(
            i.alias("nth"), F.length(F.get("_gaps", i)).alias("_gap"), c.alias("candidate"),
            F.right(F.get("_gaps", i), F.lit(CONTEXT)).alias("before"), F.left(F.get("_gaps", i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    # Written, as the rows' numbers have to stay the same.
    found = durable(found.select("_row", "doc_id", *keep, F.inline(rows)))
    upto = Window.partitionBy("_row").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("_gap") + F.length("candidate")).over(upto) - F.length("candidate")
    return found.withColumn("start", start.cast("int")).select("doc_id", *keep, "nth", "start", "candidate", "before", "after")


def letter_runs(candidate: Column) -> Column:
    return F.transform(F.regexp_extract_all(candidate, F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: F.lower(w))


def dictionary(docs: DataFrame, min_count: int = 20, text: str = "text", share: float = 1e-5) -> DataFrame:
    """word, n: lower-case words of at least three letters that occur ``min_count`` times in all texts and are ``share`` of all words.

    There are at most 1 / ``share`` of them, however large the corpus.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("(?<![^ \\n\\t])[a-z]{3,}(?![a-z0-9_/+=-])"), F.lit(0))).alias("word"))
    counts = durable(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(min_count, share * total))


def letter_pairs(words: DataFrame) -> list[float]:
    """Log-probabilities of the 676 letter pairs inside ``words`` (word, and n if there), each pair counted once more than seen."""
    weight = F.col("n") if "n" in words.columns else F.lit(1)
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))
    seen = words.where("length(word) > 1").select(F.explode(pairs).alias("pair"), weight.alias("n")).where(F.col("pair").rlike("^[a-z]{2}$"))
    counts = {r.pair: r.n for r in seen.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values()) + 26 * 26
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [math.log((counts.get(a + b, 0) + 1) / total) for a in letters for b in letters]


def pair_score(candidate: Column, pairs: list[float]) -> Column:
    """Mean log-probability of the neighbouring letters of ``candidate``; EVEN where no two letters are neighbours."""
    codes = F.transform(F.split(F.lower(candidate), ""), lambda c: F.when(c.rlike("^[a-z]$"), F.ascii(c) - 97))
    table = F.lit(pairs)
    scores = F.transform(codes, lambda c, i: F.get(table, F.get(codes, i - 1) * 26 + c))
    total = F.aggregate(
        scores, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, x: F.struct((acc["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (acc["n"] + x.isNotNull().cast("int")).alias("n")),
    )
    return F.when(total["n"] > 0, total["s"] / total["n"]).otherwise(EVEN)


def neighbours(before: Column, after: Column) -> Column:
    """The last four words before and the first three after a candidate, marked by their side, each once."""
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z]{2,}"), F.lit(0))
    left = F.transform(F.slice(F.reverse(words(before)), 1, 4), lambda w: F.concat(F.lit("<"), w))
    right = F.transform(F.slice(words(after), 1, 3), lambda w: F.concat(F.lit(">"), w))
    return F.array_distinct(F.concat(left, right))


def neighbour_odds(found: DataFrame, least: int = 5) -> DataFrame:
    """word, odds: log-odds of a secret where ``word`` stands beside it, from candidates with a label ``secret``; words seen ``least`` times."""
    words = found.select("secret", F.explode(neighbours(F.col("before"), F.col("after"))).alias("word"))
    good, bad = F.sum(F.col("secret").cast("long")), F.sum(1 - F.col("secret").cast("long"))
    totals = found.agg(good.alias("g"), bad.alias("b")).first()
    even = math.log(((totals["g"] or 0) + 1) / ((totals["b"] or 0) + 1))
    counts = words.groupBy("word").agg(good.alias("g"), bad.alias("b")).where(F.col("g") + F.col("b") >= least)
    return counts.select("word", (F.log((F.col("g") + 0.5) / (F.col("b") + 0.5)) - even).alias("odds"))


def with_features(found: DataFrame, words: DataFrame, odds: DataFrame | None = None, pairs: list[float] | None = None) -> DataFrame:
    """Add FEATURES (double). Dictionary coverage joins the candidates' letter runs with ``words``, their neighbours with ``odds``.

    Without ``odds`` every neighbouring word counts 0; ``pairs`` are the words' letter_pairs where these are known already.
    """
    pairs = letter_pairs(words) if pairs is None else pairs
    near = neighbours(F.col("before"), F.col("after"))
    found = durable(found.withColumns({"_key": F.sha2("candidate", 256), "_near": F.sha2(F.concat_ws(" ", F.sort_array(near)), 256)}))
    if odds is None:
        found = found.withColumn("_beside", F.lit(0.0))
    else:
        sides = found.groupBy("_near").agg(F.any_value(near).alias("words")).select("_near", F.explode("words").alias("word"))
        beside = sides.join(odds, "word").groupBy("_near").agg(F.round(F.sum("odds"), 9).alias("_beside"))
        found = found.join(beside, "_near", "left")
    runs = found.select("_key", F.explode(letter_runs(F.col("candidate"))).alias("word"))
    runs = runs.distinct().join(words, "word", "left_semi")
    cover = runs.groupBy("_key").agg(F.sum(F.length("word")).alias("_cover"))
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    return found.join(cover, "_key", "left").withColumns(
        {
            "length": n,
            "changes": share(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
            "pairs": pair_score(c, pairs),
            "digits": share("[0-9]"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "known": F.least(F.coalesce(F.col("_cover"), F.lit(0)) / n, F.lit(1.0)),
            "path_marks": share("[/.]"),
            "dots": share("[.]"),
            "at": (F.col("before").rlike(r"@\S*$") | F.col("after").rlike(r"^\S{0,3}@")).cast("double"),
            "in_path": F.col("before").rlike(r"(://|[/\\])\S*$").cast("double"),
            "named": F.col("before").rlike(NAMING + r"\W{0,6}\w{0,8}\W{0,4}$").cast("double"),
            "harmless": (F.col("before").rlike(HARMLESS + r"\W{0,6}$") | c.rlike(r"(?i)(example|sample|placeholder|x{6,})")).cast("double"),
            "beside": F.coalesce("_beside", F.lit(0.0)),
            "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
            "hex": c.rlike("^[0-9a-fA-F]+$").cast("double"),
            "upper": share("[A-Z]"),
            "format": c.rlike("^" + FORMAT).cast("double"),
        }
    ).drop("_cover", "_key", "_near", "_beside")


#: Words around made findings where the corpus has none to give.
FILLER = tuple("it was the report see notes on of them all and then in we had for this that from with under over".split())


def common_words(words: DataFrame, n: int = 200) -> list[str]:
    """The ``n`` most frequent words of a dictionary (word, n), FILLER if there are few."""
    top = [r.word for r in words.orderBy(F.desc("n"), "word").limit(n).collect()] if "n" in words.columns else []
    return top if len(top) >= len(FILLER) else list(FILLER)


def sample_findings(spark: SparkSession, rows: int = 6000, filler: list[str] | None = None) -> DataFrame:
    """text, secret (1 or 0): ``rows`` findings of many kinds, keys and look-alikes, among words of ``filler``; made from the digests of their numbers."""
    filler = filler or list(FILLER)
    words = F.lit(filler)
    number = lambda most, salt=0: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most))
    one_of = lambda salt, *xs: F.get(F.array(*map(F.lit, xs)), number(len(xs), salt).cast("int"))
    cut = lambda x, a, n: F.substring(x, a, n)
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    drawn = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.get(words, F.pmod(F.xxhash64("id", k), F.lit(len(filler))).cast("int")))
    hex_, b64 = F.col("hex"), F.col("b64")
    base = spark.range(rows).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hex"), drawn.alias("words"))
    base = base.withColumn("b64", F.regexp_replace(F.base64(F.unhex("hex")), "[/+=]", "7")).withColumns(
        {
            "digits": F.regexp_replace(F.translate("hex", "abcdef", "274916"), "^0", "5"), "letters": F.upper(F.translate("hex", "0123456789", "GHJKMNPQRS")),
            "lower": F.translate("hex", "0123456789", "ghjkmnpqrs"), "up": F.upper(F.regexp_replace("b64", "[^A-Za-z0-9]", "Q")),
            "year": (number(30, 3) + 1995).cast("string"), "small": (number(90, 4) + 1).cast("string"), "month": F.lpad((number(12, 5) + 1).cast("string"), 2, "0"),
            "day": F.lpad((number(28, 6) + 1).cast("string"), 2, "0"), "host": one_of(7, "mail", "mx", "smtp", "host", "node", "www", "box"),
            "site": one_of(8, "example", "company", "university", "sample-site"), "top": one_of(9, ".com", ".org", ".co.uk", ".net"),
        }
    )
    # Written, so that the findings read short expressions.
    base = durable(base)
    digits, letters, lower, up, year, small = (F.col(c) for c in ("digits", "letters", "lower", "up", "year", "small"))
    word = lambda i: F.get("words", F.lit(i))
    day = text(year, "-", F.col("month"), "-", F.col("day"))
    domain = text(F.col("host"), small, ".", F.col("site"), F.col("top"))
    person = text(cut(lower, 3, 9), ".", cut(lower, 20, 5), small)
    keys = [
        text('token = "', cut(hex_, 1, 40), '"'), text('TOKEN = "', F.upper(cut(hex_, 1, 40)), '"'), text("AKIA", cut(up, 1, 15), "7"), text("api_key: 4", cut(b64, 1, 31)),
        text("secret=ghp_9", cut(b64, 2, 35)), text('password: "z', cut(b64, 3, 18), '3"'), text("AKIA", cut(letters, 1, 16)), text('password: "', cut(b64, 5, 9), '"'),
        text("-----BEGIN ", one_of(10, "RSA ", "EC ", ""), "PRIVATE KEY-----"), text("export API_TOKEN=", cut(hex_, 5, 32)), text("Authorization: Bearer eyJ", cut(b64, 1, 20), ".", cut(b64, 9, 30)),
        text("xoxb-", cut(digits, 1, 11), "-", cut(b64, 4, 24)), text("sk-", cut(b64, 2, 40)), text('"client_secret": "', cut(b64, 1, 36), '"'), text("db_password=", cut(b64, 7, 14), "9"),
        text("access_key = '", cut(b64, 3, 30), "'"),
    ]
    others = [
        text("secret: ", one_of(11, "report", "annual", "news", "none", "required", "string")), text("token: ", one_of(12, "optional", "missing", "expired", "invalid", "bearer")),
        text("commit ", cut(hex_, 1, 40)), text("https://www.example.com/news/", number(3000).cast("string"), "/annual-report.html"),
        text("uuid ", F.regexp_replace(cut(hex_, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")), cut(digits, 1, 16), text("card ", cut(digits, 3, 16)), text("call ", cut(digits, 2, 16)),
        text('api_key = "EXAMPLEKEY', small, 'xxxxxxxx"'), text(person, "@", domain), text(cut(lower, 3, 3), small, "@", domain), text("@", domain), domain, text("see ", domain, "/", word(12)),
        text("+", cut(digits, 1, 3), "-", cut(digits, 4, 3), "-", cut(digits, 7, 9)), text(word(13), "_final_", day, ".pdf"),
        text("version ", word(14), "-", small, ".10.3-beta.4"), text("/usr/lib/", word(15), small, "/site-packages/", word(16)), text("sha256: ", hex_), text("md5 ", cut(hex_, 9, 32)),
        text("ORDER-", year, "-", cut(digits, 1, 9)), text("IMG_", F.replace(day, F.lit("-"), F.lit("")), "_", cut(digits, 2, 6), ".jpg"), text("password: your", word(17), "here"), text("id=", cut(digits, 1, 18)),
        text("session ", cut(digits, 1, 10), ".", cut(digits, 12, 8)),
    ]
    bodies = [(1, x) for x in keys] + [(0, x) for x in others]
    # A few kinds a table, for short generated code.
    tables = []
    for at in range(0, len(bodies), 8):
        some = bodies[at : at + 8]
        which = F.pmod(F.col("id"), F.lit(len(bodies))) - at
        body, label = F.get(F.array(*[x for _, x in some]), which.cast("int")), F.get(F.array(*[F.lit(y) for y, _ in some]), which.cast("int"))
        tables.append(base.where(which.between(0, len(some) - 1)).select("id", "words", body.alias("body"), label.alias("secret")))
    found = reduce(DataFrame.unionByName, tables)
    side = lambda first: F.array_join(F.slice("words", first, 6), " ")
    return found.select("id", text(side(1), one_of(13, " ", " ", "\n", ", ", ": "), F.col("body"), one_of(14, " ", " ", "\n", ". ", ", "), side(7)).alias("text"), "secret")


def train(findings: DataFrame, words: DataFrame, seed: int = 11, pairs: list[float] | None = None) -> tuple[RandomForestClassificationModel, DataFrame]:
    """The model and the neighbours' odds of ``fitted``."""
    return fitted(findings, words, seed, pairs)[:2]


def fitted(
    findings: DataFrame, words: DataFrame, seed: int = 11, pairs: list[float] | None = None, held_out: int = 5,
) -> tuple[RandomForestClassificationModel, DataFrame, float]:
    """Fit the forest on the first candidate of each labelled text (text, secret; other columns are not used).

    Returns the model, the neighbours' odds, and the limit of probability with the best F1 on the one in ``held_out`` texts that was not
    trained on (the middle of equal ones; 0.5 where none was held out).
    """
    numbered = findings.select(F.monotonically_increasing_id().alias("doc_id"), "text", "secret", (F.pmod(F.xxhash64("text"), F.lit(held_out)) == 0).alias("held"))
    found = candidates(numbered, keep=("secret", "held")).where("nth = 0")
    odds = durable(neighbour_odds(found.where("not held")))
    rows = with_features(found, words, odds, pairs)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("label", F.col("secret").cast("double")))
    rows = durable(rows.select("features", "label", "held"))
    model = RandomForestClassifier(numTrees=30, maxDepth=7, seed=seed).fit(rows.where("not held").select("features", "label"))
    return model, odds, best_limit(model.transform(rows.where("held")).select("label", vector_to_array("probability")[1].alias("p")))


def best_limit(scored: DataFrame) -> float:
    """The limit with the best F1 of (label, p), p in hundredths; what comes to the driver are counts per hundredth."""
    bins = scored.groupBy(F.floor(F.col("p") * 100).cast("int").alias("b")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    good = sum(r.good for r in bins)
    if not good:
        return 0.5
    f1 = [2 * sum(r.good for r in bins if r.b >= limit) / (sum(r.n for r in bins if r.b >= limit) + good) for limit in range(1, 100)]
    best = [i + 1 for i, x in enumerate(f1) if x == max(f1)]
    return best[len(best) // 2] / 100


def scan(docs: DataFrame, findings: DataFrame | None = None, limit: float | None = None) -> DataFrame:
    """One row per candidate: doc_id, nth, start, length, key_sha256, the features, probability, is_secret.

    Without ``findings`` they are made from rules among the corpus's own common words; without ``limit`` the held-out findings set it.
    """
    words = durable(dictionary(docs))
    pairs = letter_pairs(words)
    if findings is None:
        findings = sample_findings(docs.sparkSession, filler=common_words(words))
    model, odds, best = fitted(findings, words, pairs=pairs)
    limit = best if limit is None else limit
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(docs), words, odds, pairs))
    scored = model.transform(rows).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select(
        "doc_id", "nth", "start", F.col("length").cast("int").alias("length"), F.sha2("candidate", 256).alias("key_sha256"),
        *[f for f in FEATURES if f != "length"], "probability", (F.col("probability") >= limit).alias("is_secret"),
    )
