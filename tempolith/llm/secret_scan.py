"""Secret scan with a random forest that removes false positives; DataFrame and SQL functions only.

Candidates are values after a key word and = or :, known prefixes with 8 or more characters of
keys, and runs of 12 or more of them with a digit.  Each has features of its
length, character classes and their transitions, dictionary coverage, the document's path and
the neighbouring words.  The dictionary holds the words that most documents of the corpus have,
counted over all of them.  A random forest (Spark's own, on the JVM) is fitted on labelled
findings: by default rows made by rule, or any table of the same columns, of which at most
``max_labelled`` rows are used.

Defined cases: null and empty texts have no findings; repeated rows repeat their findings;
a null path counts as an empty one; very long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

_KEY = r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api[ _-]?key|auth|bearer|credential|private|aws)[A-Za-z0-9_\-]{0,16}[\"']?\s{0,3}[=:]"
_RUN = r"[A-Za-z0-9_+/\-]"
#: A key word, = or :, and its value in quotes or up to a space; a known prefix; or a long run with a digit, if it is no key itself.
FINDING = (
    r"(?=[acpstbACPSTB])" + _KEY + r"\s{0,3}(?:[\"'`][^\"'`\r\n]+|(?![=:])[^\s\"'`]+)"
    r"|(?<!" + _RUN + r")(?:(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[bap]-|AIza|eyJ|glpat-)" + _RUN + r"{8,}"
    r"|(?=" + _RUN + r"{12})(?=" + _RUN + r"*[0-9])(?![A-Za-z0-9_\-]*" + _KEY + r")" + _RUN + r"{12,})"
)
_LEAD = "^" + _KEY + r"\s{0,3}[\"'`]?"
#: Code points of neighbouring text that features see.
CONTEXT = 48
_BLOCK = 256
_KEYWORDS = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[ _-]?key|auth|bearer|credential|private|aws)"
_NOT_KEYS = r"(?i)(commit|sha(1|256)?|md5|checksum|hash|digest|uuid|guid|version|build|order|invoice|isbn|phone|card|call|account|id)"
#: Words of the dictionary, and their letters.
DICTIONARY, WORD_LETTERS = 2_000, (4, 12)
FEATURES = (
    "f_len f_digits f_upper f_lower f_signs f_turns f_distinct f_hex f_number f_words f_prefix f_example f_key f_key_near f_not_key f_assign "
    "f_quoted f_path"
).split()


def _share(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")) / F.char_length(text)


def frequent_words(docs: DataFrame, text_col: str = "text", count: int = DICTIONARY) -> list[str]:
    """The ``count`` words, runs of 4 to 12 of a-z, that most documents have; ties in the order of words."""
    found = F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z]+"))
    each = docs.select(F.explode(found).alias("word")).where(F.length("word").between(*WORD_LETTERS))
    counted = each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(count)
    return [r.word for r in counted.collect()]


def _any_word(words: Iterable[str]) -> str:
    """A pattern of all words, longest first, split by their first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by.items())) + ")"


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """found (cand, before, after, path) with FEATURES as doubles."""
    c, before, after = F.col("cand"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "_"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    known = F.regexp_replace(F.lower(c), _any_word(dictionary), "") if dictionary else c
    flag = lambda test: test.cast("double")
    values = {
        "f_len": F.log(F.char_length(c)),
        "f_digits": _share(c, "[^0-9]"),
        "f_upper": _share(c, "[^A-Z]"),
        "f_lower": _share(c, "[^a-z]"),
        "f_signs": _share(c, "[A-Za-z0-9]"),
        "f_turns": F.char_length(F.regexp_replace(classes, r"(.)\1*", "x")) / F.char_length(c),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.char_length(c),
        "f_hex": flag(c.rlike("^[0-9a-f]+$")),
        "f_number": flag(c.rlike("^[0-9/+_-]+$")),
        "f_words": 1 - F.char_length(known) / F.char_length(c),
        "f_prefix": flag(c.rlike("^(AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[bap]-|AIza|eyJ|glpat-)")),
        "f_example": flag(c.rlike(r"(?i)(example|sample|dummy|changeme|x{4}|0{6}|1234567)|(.)\2{4}")),
        "f_key": flag(before.rlike(_KEYWORDS)),
        "f_key_near": flag(before.rlike(_KEYWORDS + r"\W{0,4}$")),
        "f_not_key": flag(before.rlike(r"(?i)\b" + _NOT_KEYS[4:] + r"\W{0,4}$")),
        "f_assign": flag(before.rlike("[=:]\\s*[\"']?$")),
        "f_quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "f_path": flag(F.coalesce("path", F.lit("")).rlike("(?i)(test|example|sample|fixture|mock|doc)")),
    }
    return found.withColumns(values)


def labelled_findings(spark: SparkSession, dictionary: list[str], rows: int = 8_000, first: int = 0) -> DataFrame:
    """cand, before, after, path and label: findings made by rule from numbers on from ``first``, secrets and look-alikes."""
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    number = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    upper = lambda salt: F.translate(F.upper(h(salt)), "0123456789ABCDEF", "QW7RTY2UIP5SDFGH")
    mixed = lambda salt: F.base64(F.unhex(h(salt)))
    plain = lambda salt: F.regexp_replace(mixed(salt), "[+/=]", "k")
    digits = lambda salt: F.translate(h(salt), "abcdef", "135792")
    listed = F.array(*[F.lit(w) for w in (dictionary or ["word"])[:500]])
    noise = F.concat(F.element_at(listed, number("w", min(500, len(dictionary) or 1)) + 1), F.element_at(F.array(*[F.lit(x) for x in ("", ",", ".", " |")]), number("W", 4) + 1))
    word, other = (F.element_at(listed, number(x, min(500, len(dictionary) or 1)) + 1) for x in "do")
    mark = F.element_at(F.array(*[F.lit(w) for w in ". ! @ $ # %".split()]), number("m", 6) + 1)
    letters = lambda text: F.translate(text, "0123456789", "KQWRTYUPSD")
    key = F.element_at(F.array(*[F.lit(w) for w in "password passwd pwd secret token api_key apikey auth_token client_secret".split()]), number("k", 9) + 1)
    sign = F.element_at(F.array(*[F.lit(w) for w in ["=", " = ", ": ", "=\"", " = \"", ": '"]]), number("s", 6) + 1)
    fact = F.element_at(F.array(*[F.lit(w) for w in "commit sha256 md5 checksum uuid order version build invoice".split()]), number("f", 9) + 1)
    cut = lambda text, low, span, salt: F.substring(text, F.lit(1), F.lit(low) + number(salt, span))
    empty, space = F.lit(""), F.concat(noise, F.lit(" "))
    assigned = F.concat(noise, F.lit(" "), key, sign)
    dashed = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))
    made = [
        # secrets: (candidate, text before, label)
        (F.concat(F.lit("AKIA"), F.substring(upper("a"), 1, 16)), space, 1),
        (F.concat(F.lit("AKIA"), F.substring(upper("b"), 1, 16)), assigned, 1),
        (cut(h("c"), 12, 20, "c"), assigned, 1),
        (F.substring(h("d"), 1, 40), assigned, 1),
        (cut(plain("e"), 16, 26, "e"), assigned, 1),
        (F.concat(F.lit("ghp_"), F.substring(plain("f"), 1, 36)), space, 1),
        (F.concat(F.lit("sk_live_"), F.substring(plain("g"), 1, 24)), space, 1),
        (F.concat(F.lit("eyJ"), F.substring(plain("h"), 1, 36)), assigned, 1),
        (cut(mixed("i"), 30, 10, "i"), assigned, 1),
        (F.concat(word, F.substring(plain("j"), 1, 8)), F.concat(noise, F.lit(" password"), sign), 1),
        (F.concat(F.lit("AKIA"), letters(F.substring(upper("A"), 1, 16))), space, 1),
        (cut(letters(plain("B")), 10, 24, "B"), assigned, 1),
        (F.concat(F.initcap(word), F.initcap(other), F.initcap(word)), assigned, 1),
        (F.concat(cut(plain("C"), 1, 4, "C"), mark, F.substring(plain("D"), 1, 3), mark, F.substring(plain("E"), 1, 2)), assigned, 1),
        # look-alikes
        (word, assigned, 0),
        (other, assigned, 0),
        (F.element_at(F.array(*[F.lit(w) for w in "None null true false required the is optional".split()]), number("y", 8) + 1), assigned, 0),
        (F.concat_ws("-", F.lit("sk"), word, other), space, 0),
        (F.substring(digits("k"), 1, 16), space, 0),
        (cut(digits("l"), 12, 20, "l"), F.concat(noise, F.lit(" "), fact, F.lit(" ")), 0),
        (F.substring(h("m"), 1, 40), F.concat(noise, F.lit(" "), fact, F.lit(" ")), 0),
        (h("n"), F.concat(fact, F.lit(": ")), 0),
        (dashed, F.concat(noise, F.lit(" id=")), 0),
        (F.concat_ws("-", word, F.lit("the"), word, F.substring(digits("o"), 1, 4)), F.concat(noise, F.lit(" /")), 0),
        (F.concat(F.lit("20"), F.substring(digits("p"), 1, 2), F.lit("-12-0"), F.substring(digits("p"), 3, 1), F.lit("T10_"), F.substring(digits("p"), 4, 2)), space, 0),
        (F.concat(F.lit("changeme"), F.substring(digits("q"), 1, 6)), assigned, 0),
        (F.concat(F.lit("AKIAEXAMPLE"), F.substring(digits("r"), 1, 9)), assigned, 0),
        (F.concat(word, word, F.substring(digits("t"), 1, 3)), space, 0),
    ]
    pick = lambda i: F.element_at(F.array(*[(F.lit(m[i]) if i == 2 else m[i]).cast("string" if i < 2 else "double") for m in made]), F.col("kind") + 1)
    base = spark.range(first, first + rows).withColumn("kind", (F.col("id") % len(made)).cast("int"))
    opened = F.when(pick(1).rlike("\"$"), "\" ").when(pick(1).rlike("'$"), "' ").otherwise(" ")
    path = F.when(number("x", 10) == 0, F.concat(F.lit("tests/"), word)).otherwise(F.concat(F.lit("src"), number("y", 40).cast("string")))
    return base.select(pick(0).alias("cand"), pick(1).alias("before"), F.concat(opened, noise, empty).alias("after"), path.alias("path"), pick(2).alias("label"))


def fit(labelled: DataFrame, dictionary: list[str], *, trees: int = 30, depth: int = 8, max_labelled: int = 50_000, seed: int = 5) -> RandomForestClassificationModel:
    """A forest over FEATURES from at most max_labelled labelled findings."""
    rows = with_features(labelled.limit(max_labelled), dictionary).select(*FEATURES, "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)


def candidates(docs: DataFrame, *, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """doc_id, digest (of the text), start (code points, from 0), cand, before, after and path of every candidate."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(path_col).cast("string").alias("path")).where(text.rlike(FINDING))
    cut = slim.select(
        "doc_id", "path", F.md5(F.col("text").cast("binary")).alias("digest"),
        F.regexp_extract_all("text", F.lit(FINDING), F.lit(0)).alias("found"),
        F.split("text", FINDING, -1).alias("between"),
    )
    # sums in two steps, over blocks and inside one, keep a text of many candidates cheap
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    sized = cut.withColumn("sizes", F.zip_with("found", "between", lambda c, b: F.char_length(b) + F.coalesce(F.char_length(c), F.lit(0))))
    sized = sized.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.floor(F.size("found") / _BLOCK).cast("int")), lambda j: total(F.slice("sizes", j * _BLOCK + 1, _BLOCK))))
    before = lambda i: total(F.slice("blocks", F.lit(1), F.floor(i / _BLOCK).cast("int"))) + total(F.slice("sizes", F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))
    starts = F.transform(F.sequence(F.lit(0), F.size("found") - 1), lambda i: before(i) + F.char_length(F.get("between", i)))
    count = F.size("found")
    parts = F.arrays_zip("found", F.slice("between", F.lit(1), count).alias("left"), F.slice("between", F.lit(2), count).alias("right"), starts.alias("start"))
    each = sized.select("doc_id", "path", "digest", F.explode(parts).alias("x")).withColumn("lead", F.regexp_extract("x.found", _LEAD, 0))
    return each.select(
        "doc_id", "digest", (F.col("x.start") + F.char_length("lead")).cast("long").alias("start"),
        F.substring("x.found", F.char_length("lead") + 1, F.char_length("x.found")).alias("cand"),
        F.right(F.concat("x.left", "lead"), F.lit(CONTEXT)).alias("before"), F.left("x.right", F.lit(CONTEXT)).alias("after"), "path",
    )


def scan(docs: DataFrame, model: RandomForestClassificationModel, dictionary: list[str], *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", cutoff: float = 0.5) -> DataFrame:
    """doc_id, digest, start, length, cand, score and is_secret of every candidate."""
    found = with_features(candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col), dictionary)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    scored = model.transform(vectors).withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 9))
    return scored.select("doc_id", "digest", "start", F.char_length("cand").cast("long").alias("length"), "cand", "score", (F.col("score") >= cutoff).alias("is_secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel, dictionary: list[str], *, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of a text replaced by mark; columns and rows stay."""
    key, digest, secrets = fresh(docs, "key"), fresh(docs, "digest"), fresh(docs, "secrets")
    found = scan(docs, model, dictionary, id_col=id_col, text_col=text_col, path_col=path_col).where("is_secret")
    grouped = found.groupBy(F.col("doc_id").alias(key), F.col("digest").alias(digest)).agg(F.collect_set("cand").alias(secrets))
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.md5(docs[text_col].cast("binary")) == F.col(digest))
    longest_first = F.array_sort(F.col(secrets), lambda a, b: F.char_length(b) - F.char_length(a))
    cut = F.aggregate(longest_first, F.col(text_col), lambda acc, s: F.replace(acc, s, F.lit(mark)))
    new = F.when(F.col(secrets).isNull(), F.col(text_col)).otherwise(cut)
    return docs.join(grouped, same, "left").select(*[new.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, score and is_secret of every candidate of every document."""
    dictionary = frequent_words(docs)
    model = fit(labelled_findings(docs.sparkSession, dictionary), dictionary)
    return scan(docs, model, dictionary).select("doc_id", "start", "length", F.sha2(F.col("cand").cast("binary"), 256).alias("cand_sha256"), "score", "is_secret")
