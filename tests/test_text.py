"""Token, stem and label expressions against published values and plain Python."""

import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from cinegrade.catalog import features
from cinegrade.fixed_values import ENGLISH_STOP_WORDS
from cinegrade.functions import labels as L
from cinegrade.functions import text as X
from cinegrade.functions.stem import porter_stem, stem_tokens
from cinegrade.operators import terms
from cinegrade.operators.terms import bigrams

# Examples printed in the 1980 paper.
PAPER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


def column(spark, values, schema, make):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, v {schema}").select("i", make(F.col("v")).alias("out"))
    return [r["out"] for r in sorted(df.collect(), key=lambda r: r["i"])]


@pytest.mark.parametrize("word", sorted(PAPER))
def test_paper_stems(word):
    assert porter_stem(word) == PAPER[word]


def test_stem_tokens_keeps_rows_and_order(spark):
    bags = [["running", "cats", "running"], [], None, ["ponies"]]
    assert column(spark, bags, "ARRAY<STRING>", stem_tokens) == [["run", "cat", "run"], [], None, ["poni"]]


def test_stop_words_are_sparks(spark):
    assert StopWordsRemover.loadDefaultStopWords("english") == ENGLISH_STOP_WORDS


TEXTS = ["Hello, World-wide web!", "", "a b cc", "don't   stop_me  3D x-", "Ünïcode naïve café", "\t\n"]


def test_clean_tokens(spark):
    want = [[w for w in re.findall(r"[\w-]+", t.lower(), re.ASCII) if len(w) > 1] for t in TEXTS]
    assert column(spark, TEXTS, "STRING", X.clean_tokens) == want


def test_counted_terms(spark):
    bags = [["b", "a", "b"], [], ["x"], ["z", "z", "z"], None]
    got = column(spark, bags, "ARRAY<STRING>", X.counted_terms)
    assert [None if r is None else [tuple(x) for x in r] for r in got[:4]] == [
        [("a", 1), ("b", 2)], [], [("x", 1)], [("z", 3)],
    ]


def test_counted_terms_count_null_as_a_term(spark):
    (got,) = column(spark, [["b", None, "a", None, "b"]], "ARRAY<STRING>", X.counted_terms)
    assert sorted(((r["term"] or "", r["n"]) for r in got)) == [("", 2), ("a", 1), ("b", 2)]


def test_bigrams(spark):
    bags = [["a", "b", "c"], ["a"], []]
    assert column(spark, bags, "ARRAY<STRING>", bigrams) == [["a b", "b c"], [], []]


def plain_grade(tokens):
    for i, token in enumerate(tokens):
        if token != "10":
            continue
        if i == 0:
            if tokens[1:2] == ["10"]:
                return 10
        elif re.fullmatch(r"\d+", tokens[i - 1]) and int(tokens[i - 1]) < 11:
            return int(tokens[i - 1])
    return None


GRADES = [
    ["a", "7", "10"], ["10", "10"], ["10"], [], ["50", "10", "3", "10"], ["x", "10"], ["0", "10"],
    ["10", "9", "10"], ["11", "10", "10"], ["99999999999", "10"],
]


def test_grade(spark):
    assert column(spark, GRADES, "ARRAY<STRING>", L.grade) == [plain_grade(t) for t in GRADES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["10", "7", "11", "x", "0"]), max_size=6), min_size=20, max_size=60))
def test_grade_generated(spark, bags):
    assert column(spark, bags, "ARRAY<STRING>", L.grade) == [plain_grade(t) for t in bags]


def test_denial_label(spark):
    bags = [["none"], ["NADA"], ["none", "at"], ["some"], [], None]
    assert column(spark, bags, "ARRAY<STRING>", L.denial_label) == ["NEGATIVE", "NEGATIVE", None, None, None, None]


def plain_reason(reason):
    words = "".join(" " if c in string.punctuation and c != "-" else c for c in reason.lower()).split()
    if "for" in words:
        words = words[words.index("for") + 1 :]
    else:
        words = words[2:] if len(words) >= 3 else []
    return [w for w in words if w not in ENGLISH_STOP_WORDS and w not in string.punctuation]


def test_reason_tokens(spark):
    # symbols such as `$` are no punctuation to the pattern, so they stay out of the sample
    reasons = [
        "Rated R for strong violence, language and drug use.", "Rated PG", "Rated PG thematic elements",
        "for", "Rated for", "", "a - b - c", "for some sci-fi action/violence for all",
    ]
    assert column(spark, reasons, "STRING", X.reason_tokens) == [plain_reason(r) for r in reasons]


def test_comment_and_alpha_tokens(spark):
    comments = [["A man's 3rd  gun.", "None"], [], None, ["_x 1st"]]
    assert column(spark, comments, "ARRAY<STRING>", X.comment_tokens) == [
        ["a", "man", "s", "3rd", "gun", "none"], None, None, ["_x", "1st"],
    ]
    assert column(spark, [["a", "3rd", "_x", "gun"]], "ARRAY<STRING>", X.alpha_tokens) == [["a", "gun"]]


def test_titles_keys_and_ids(spark):
    assert column(spark, ["Alien: Covenant  (2017)", "x"], "STRING", X.dated_title) == ["alien covenant", ""]
    assert column(spark, ["Sex & Nudity:", "MPAA"], "STRING", X.craft_key) == ["sex_nudity", "mpaa"]
    paths = ["data/xml/en/1968/62909/6214054.xml", "7.xml.gz", "a/b"]
    assert column(spark, paths, "STRING", X.file_id) == ["6214054", "7", "b"]


def test_utf8_text_drops_invalid_bytes(spark):
    assert column(spark, [bytearray(b"caf\xc3\xa9\xff!")], "BINARY", X.utf8_text) == ["café!"]


def test_ratings(spark):
    assert column(spark, ["R", "PG", "GP"], "STRING", L.binary_rating) == ["R", "NOT_R", "NOT_R"]
    assert column(spark, ["GP", "M/PG", "R", None], "STRING", L.current_rating) == ["PG", "PG", "R", None]
    assert column(spark, ["GP", "NC-17"], "STRING", L.is_valid_rating) == [False, True]


def test_comment_targets_parse_pages_once(spark, tmp_path):
    from cinegrade.catalog import guide

    page = "<html><title>Some title words</title><nav>a <b>drink</b></nav><article>red blood and guts</article><footer>end</footer></html>"
    spark.createDataFrame([(k, f"http://x/{k}", page) for k in range(20)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, "rated for blood and guts", "en", "s", 24) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 20, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = guide.comment_targets(spark, str(tmp_path))
    assert not any("pages.parquet" in name for name in got.inputFiles())
    assert {r["imdb_id"] for r in got.where("label = 1 AND category = 'NUDITY'").collect()} >= {"2", "4"}
    assert guide.dimension_flags(spark, str(tmp_path)).count() == 20


def test_bigrams_are_counted_in_tasks_that_follow_the_text(spark, tmp_path, monkeypatch):
    """Before, a table of this many bytes was counted in as few tasks as any other."""
    texts = ["red green blue green blue", "green blue", "", None, "Red green"] * 20
    rows = [(None if i % 7 == 0 else i % 50, text) for i, text in enumerate(texts)]  # keys may repeat or be null
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(terms, "TEXT_PER_TASK", 40)
    got = features.bigram_counts(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == -(-sum(len(text or "") for text in texts) // 40)
    assert {r["bigram"]: r["n"] for r in got.collect()} == {"red green": 40, "green blue": 60, "blue green": 20}
