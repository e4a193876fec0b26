"""Token counts, languages, licenses, rules, grades, encoding, mixing, files and exact copies on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cinegrade.llm import (
    chunked_bpe,
    exact_dedup,
    language_bits,
    license_scan,
    mixing,
    ordinal,
    token_counts,
    token_files,
    tree_rules,
)
from cinegrade.llm.catalog import file_bytes

ODD = [None, "", " ", "\n", "  two  spaces ", "a\tb\r\nc", "<s></s><|endoftext|> <|endoftext|>x", "é日本 ▁▁ x▁y", "😀 \x1c\x85\xa0z", "it's we'll 'tis 12 a1",
       "x" * 50_000, "word " * 20_000, " " * 3_000 + "end"]


def odd_texts(seed=1, n=300):
    draw = random.Random(seed)
    return ODD + ["".join(draw.choice(" ab\n'sé1\x1c-\t日▁<>") for _ in range(draw.randint(0, 60))) for _ in range(n)]


def table(spark, texts, **more):
    """doc_id, text, and columns whose names the operators use inside."""
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, tokens string, n long")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_texts()).cache()


def test_token_counts_equal_the_library(spark, odd):
    from sentencepiece import SentencePieceProcessor

    model = file_bytes("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_proto=model)
    found = by_id(token_counts.token_counts(odd, model))
    for i, t in enumerate(odd_texts()):
        want = len(library.encode(t or ""))
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (want, len((t or "").encode()), want > 4096)
    assert token_counts.token_counts(odd.limit(0), model).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(chunked_bpe.CHUNK, chunked_bpe.OVERLAP), (40, 20), (64, 24)])
def test_chunked_encoding_equals_the_library_and_round_trips(spark, chunk, overlap):
    from tiktoken import Encoding

    ranks = file_bytes("byte_bpe_multi_50k.tiktoken")
    library = Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=chunked_bpe.parse_ranks(ranks), special_tokens={})
    texts = [t if t is None or len(t) < 1000 or chunk > 1000 else t[:1000] for t in odd_texts(2, 60)] + ["same text twice " * 30] * 2
    encoded = chunked_bpe.encode(table(spark, texts), ranks, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    found = by_id(chunked_bpe.decode_table(encoded, ranks))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert found[i].listed == ",".join(map(str, ids)) and found[i].n_tokens == len(ids) and bytes(found[i].bytes) == (t or "").encode()
    assert chunked_bpe.as_arrays(chunked_bpe.encode(table(spark, texts).limit(0), ranks, public_tokenizers.PATTERN)).count() == 0


def test_token_files_equal_the_library(spark, tmp_path, odd):
    from tokenizers import Tokenizer

    model = file_bytes("byte_bpe_50k.json").decode()
    library = Tokenizer.from_str(model)
    rows = odd.unionByName(spark.createDataFrame([(None, "no id", "", 0)], odd.schema))
    path = f"file://{tmp_path}/tokens"
    width = token_files.write_token_files(rows, path, model, vocab_size=50_257)
    found = by_id(token_files.read_token_files(spark, path, width))
    start = len(library.encode("no id").ids) + 1
    assert width == 2 and found[None].start == 0 and found[None].n_tokens == start
    for i, t in enumerate(odd_texts()):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = f"file://{tmp_path}/empty"
    assert token_files.read_token_files(spark, empty, token_files.write_token_files(odd.limit(0), empty, model, 50_257)).count() == 0


def test_number_of_files_follows_the_bytes(spark, tmp_path, odd):
    model, found = file_bytes("byte_bpe_50k.json").decode(), []
    for size in (1 << 30, 4_000):
        path = f"{tmp_path}/{size}"
        width = token_files.write_token_files(odd, path, model, vocab_size=50_257, file_bytes=size)
        found.append((len(list((tmp_path / str(size) / "part=ids").glob("part-*"))), sorted(map(tuple, token_files.read_token_files(spark, path, width).collect()))))
    assert found[0][0] < found[1][0] and found[0][1] == found[1][1]


def test_files_read_as_contents_equal_mapped_ones(spark, tmp_path, odd, monkeypatch):
    path = f"file://{tmp_path}/tokens"
    width = token_files.write_token_files(odd, path, file_bytes("byte_bpe_50k.json").decode(), vocab_size=70_000)
    assert width == 4
    mapped = sorted(map(tuple, token_files.read_token_files(spark, path, width).collect()))
    monkeypatch.setattr(token_files.re, "match", lambda *a: None)
    assert sorted(map(tuple, token_files.read_token_files(spark, path, width).collect())) == mapped


def test_languages_of_held_out_texts(spark):
    draw = random.Random(3)
    syllables = {"aa": "ka ti mo ru", "bb": "schl ung eit ver", "cc": "tion eau que oi"}
    make = lambda lang: " ".join("".join(draw.choices(syllables[lang].split(), k=draw.randint(1, 4))) for _ in range(30))
    taught = spark.createDataFrame([(lang, make(lang)) for lang in syllables for _ in range(20)] + [(None, "x"), ("aa", None)], "lang string, text string")
    fitted = language_bits.fit_filter(taught)
    assert fitted.languages == ("aa", "bb", "cc")
    truth = [lang for lang in syllables for _ in range(10)]
    found = by_id(language_bits.predict(table(spark, [make(lang) for lang in truth] + [None, "", "12 -- 3", "日本"]), fitted))
    assert [found[i].lang_pred for i in range(30)] == truth
    assert [(found[i].lang_pred, found[i].score) for i in range(30, 34)] == [("und", 0.0)] * 3 + [("aa", 0.0)]
    nothing = language_bits.fit_filter(taught.limit(0))
    assert by_id(language_bits.predict(table(spark, ["word"]), nothing))[0].lang_pred == "und"


def test_filter_contains_every_ngram_and_positions_agree(spark):
    fitted = language_bits.fit_filter(spark.createDataFrame([("aa", "Kati moru"), ("bb", "schlung")], "lang string, text string"))
    masks = fitted.table()
    for lang, word in (("aa", "kati"), ("bb", "schlung")):
        for gram in language_bits.grams(word):
            held = int(np.bitwise_and.reduce(masks[language_bits._positions(gram)], axis=0)[0])
            assert held >> fitted.languages.index(lang) & 1


def test_license_matches_equal_brute_force(spark):
    draw = random.Random(4)
    filler = "the of and in for to use copy software under license version x y z".split()
    texts = [None, "", "short one"]
    for _ in range(120):
        words = draw.choices(filler, k=draw.randint(0, 120))
        if draw.random() < 0.6:
            notice = draw.choice(license_scan.NOTICES)[1].split()
            if draw.random() < 0.5 and len(notice) > 12:
                notice[draw.randrange(len(notice))] = "changed"
            at = draw.randint(0, len(words))
            words = words[:at] + notice + words[at:]
        texts.append(" ".join(words))
    found = {(r.doc_id, r.template_id): r.containment for r in license_scan.license_matches(table(spark, texts), license_scan.notices(spark)).collect()}
    words_of = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want, must = {}, set()
    for name, notice in license_scan.NOTICES:
        w = words_of(notice)
        target = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        width = 1
        while width < len(target):
            width *= 2
        for i, t in enumerate(texts):
            w = words_of(t)
            shingles = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
            best = max((len(target & set(shingles[max(k, 0) : k + 3 * width])) / len(target) for k in range(-2 * width, max(len(shingles), 1), width)), default=0)
            if best >= 0.8:
                want[i, name] = max(best, want.get((i, name), 0))
            if any(len(target & set(shingles[k : k + 2 * width])) / len(target) >= 0.8 for k in range(len(shingles))):
                must.add((i, name))
    assert found == pytest.approx(want) and must <= set(found) and len(must) > 40
    assert license_scan.license_matches(table(spark, texts).limit(0), license_scan.notices(spark)).count() == 0


def test_inserted_words_cost_no_match_at_any_place(spark):
    """A template of 68 words with 30 words in its middle is found at each of 64 places, by the bands as well."""
    template = " ".join(f"t{k}" for k in range(68))
    parts = template.split()
    known = parts[5:40] + parts[:20]  # filler of the template's own words, so that it fills windows too
    bodies, draw = [], random.Random(5)
    for at in range(64):
        filler = draw.choices(known, k=at)
        bodies.append(" ".join([*filler, *parts[:34], *(f"x{k}" for k in range(30)), *parts[34:], *draw.choices(known, k=40)]))
    found = license_scan.license_matches(table(spark, bodies + bodies[:3]), spark.createDataFrame([("long", template)], "template_id string, text string")).collect()
    assert len(found) == 67 and min(r.containment for r in found) >= 60 / 64


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_base_counts_equal_brute_force():
    for t in odd_texts(5):
        assert tree_rules.statistics((t or "").encode())[:5] == brute_counts(t or "")


def test_trees_keep_their_directions_and_learn(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(3000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * draw.normal(size=3000)) > 0).astype(float)
    trees = tree_rules.grow(x, y, [1, -1, 0])
    assert ((trees.probability(x) >= 0.5) == y).mean() > 0.9
    for feature, direction in ((0, 1), (1, -1)):
        moved = np.repeat(x[:50], 40, axis=0)
        moved[:, feature] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(trees.raw(moved).reshape(50, 40), axis=1)
        assert (direction * steps >= -1e-9).all()


def test_rules_without_labels_only_apply_the_base(spark):
    docs = table(spark, [None, "one two", " ".join(f"w{i}" for i in range(80)), "same three words " * 40])
    trees = tree_rules.fit_rules(docs, spark.createDataFrame([(None, 1)], "doc_id long, quality int"))
    found = by_id(tree_rules.judge(docs, trees))
    assert [found[i].base_failed for i in range(4)] == [True, True, False, True]
    assert [found[i].kept for i in range(4)] == [False, False, True, False]
    assert tree_rules.judge(docs.limit(0), trees).count() == 0


def test_grades_are_ordered_and_separate(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    telling = {0: ["junk", "###"], 1: ["idiot"], 2: []}
    texts, grades = [], []
    for i in range(600):
        g = i % 3
        body = draw.choices(words, k=80) + [draw.choice(telling[g]) for _ in range(6) if telling[g]]
        draw.shuffle(body)
        texts.append(" ".join(body))
        grades.append((i, g))
    docs = table(spark, [*texts, None, ""])
    ratings = spark.createDataFrame([*grades[:450], (None, 1), (599, None)], "doc_id long, grade int")
    model = ordinal.fit_ordinal(docs, ratings)
    assert model.thresholds[0] < model.thresholds[1]
    found = by_id(ordinal.grade(docs, model, select=2, least=0.5))
    right = [found[i].kept == (g == 2) for i, g in grades[450:]]
    assert np.mean(right) > 0.95 and len(found) == 602
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in found.values())
    nothing = ordinal.fit_ordinal(docs, ratings.limit(0))
    assert all(r.kept for r in ordinal.grade(docs, nothing, select=1).collect())


def plain_loss(weights, thresholds, rows, known):
    """Mean loss of the tails, one text and one grade at a time."""
    total = 0.0
    for grade, buckets, values in rows:
        s = sum(weights[b] * v for b, v in zip(buckets, values))
        for k in known:
            p = 1 / (1 + np.exp(-(s - thresholds[k - 1])))
            total -= np.log(p if grade >= k else 1 - p)
    return total / len(rows)


@pytest.mark.parametrize("n", [2, 30, 3000])
def test_few_and_many_ratings_keep_good_texts(n):
    draw = random.Random(n)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    bad = lambda g: ["garble", "junkish"][g] if g < 2 else "plain"
    text = lambda g: " ".join(draw.choices(words, k=30) + [bad(g)] * 3)
    grades = [(2, 2, 0, 2, 2, 1)[i % 6] for i in range(n)]
    rows = [(g, *ordinal.hashed_counts(text(g))) for g in grades]
    model = ordinal.fit(rows, grades=3)
    assert len(model.thresholds) == 2
    fresh = [(g, text(g)) for g in (0, 1, 2, 2) * 50]
    tails = model.tails(ordinal.scores([t for _, t in fresh], model))[:, 1]
    if n == 2:  # only good texts: nothing to tell apart
        assert (tails == 1).all()
        return
    good = np.array([g == 2 for g, _ in fresh])
    assert tails[good].mean() > tails[~good].mean() + (0.05 if n == 30 else 0.5)
    weights = np.frombuffer(model.weights)
    base = [float(np.log((1 - s) / s)) for s in (np.mean([g >= k for g in grades]) for k in (1, 2))]
    assert plain_loss(weights, model.thresholds, rows[:300], (1, 2)) < plain_loss(np.zeros_like(weights), base, rows[:300], (1, 2))


def test_grades_that_nobody_gives_reject_nothing():
    rows = [(i % 2, *ordinal.hashed_counts("good text here" if i % 2 else "bad words there")) for i in range(40)]
    model = ordinal.fit(rows, grades=3)
    tails = model.tails(ordinal.scores(["good text here", "bad words there", ""], model))
    assert (tails[:, 1] == 1).all() and tails[0, 0] > 0.5 > tails[1, 0]
    assert ordinal.word_features("-" * 25 + "x") != ordinal.word_features("-" * 26 + "x")


def test_letters_are_those_of_unicode(spark):
    assert language_bits.letter_runs("½") == language_bits.letter_runs("x²")[1:] == []
    assert language_bits.letter_runs("aⅧb3Éc_d") == ["a", "b", "éc", "d"]
    docs = table(spark, ["the cat sat on the mat", "le chat noir", "½", "²", "Ⅷ 12", "cat", None, "the cat sat on the mat", "the cat " * 40_000])
    fitted = language_bits.fit_filter(docs.where("doc_id < 2").selectExpr("if(doc_id = 0, 'en', 'fr') as lang", "text"))
    found = by_id(language_bits.predict(docs, fitted))
    assert [found[i].lang_pred for i in (2, 3, 4, 6)] == ["und"] * 4 and {found[i].score for i in (2, 3, 4, 6)} == {0.0}
    assert found[5].lang_pred == found[8].lang_pred == "en" and found[0].score == found[7].score
    assert language_bits.predict(docs.limit(0), fitted).count() == 0


def test_rows_of_one_id_stay_together_when_sorts_spill(spark, tmp_path):
    """Ids and index records of repeated ids belong together, in whatever order spilled parts are merged."""
    from tokenizers import Tokenizer

    model = file_bytes("byte_bpe_50k.json").decode()
    library = Tokenizer.from_str(model)
    draw = random.Random(11)
    texts = [" ".join(draw.choice("abcdefg") * draw.randint(1, 4) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    docs = spark.createDataFrame([(7 if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    conf = spark._jvm.org.apache.spark.SparkEnv.get().conf()
    conf.set("spark.shuffle.spill.numElementsForceSpillThreshold", "200")
    try:
        path = str(tmp_path / "tokens")
        width = token_files.write_token_files(docs, path, model, vocab_size=50_257)
        found = token_files.read_token_files(spark, path, width).collect()
    finally:
        conf.remove("spark.shuffle.spill.numElementsForceSpillThreshold")
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want[(7 if i % 2 else None, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want


def test_places_order_both_files():
    """Every row of a partition's pass has its own place, the same for its ids and its index record, over batches."""
    import pyarrow as pa

    model = file_bytes("byte_bpe_50k.json").decode()
    batch = lambda ids, texts: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(token_files.encoded(iter([batch([7, 7, None], ["a b", "", "c"]), batch([7, 8], ["d", "e f g"])]), model, 2))
    places = {k: [p for o in out for kind, p in zip(o.column("part").to_pylist(), o.column("place").to_pylist()) if kind == k] for k in ("ids", "index")}
    assert places["ids"] == places["index"] == [0, 1, 2, 3, 4]
    records = b"".join(v + b"\0\0" for o in out for kind, v in zip(o.column("part").to_pylist(), o.column("value").to_pylist()) if kind == "index")
    index = np.frombuffer(records, token_files.INDEX)
    assert (index["start"] == np.cumsum(index["n_tokens"]) - index["n_tokens"]).all() and index["doc_id"].tolist() == [7, 7, token_files.NULL_ID, 7, 8]


def test_grades_of_labels(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in ordinal.grades_of(labels).collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: None}


def test_mixture_meets_weights_and_limit(spark):
    draw = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(draw.randint(1, 40))), "big" if i % 3 else f"s{i % 5}", "x") for i in range(900)]
    rows += [(2000, None, "silent", "x"), (2001, "a b", None, "x"), (2001, "a b", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")
    found = mixing.mixture(docs, max_repeats=2.0, block_tokens=200).drop("whole").collect()
    assert len(found) == len(rows) and min(r.n_passes for r in found) >= 1 and max(r.n_passes for r in found) <= 2
    seen, once = Counter(), Counter()
    for r in found:
        seen[r.source] += r.n_tokens * r.n_passes
        once[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in found}
    total = max(once[s] / w for s, w in weight.items() if w)
    for s, w in weight.items():
        assert seen[s] == pytest.approx(w * total, abs=41)
    again = mixing.mixed(docs, max_repeats=2.0, block_tokens=200)
    assert again.columns == docs.columns and again.count() == sum(r.n_passes for r in found)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_exponent_meets_entropy_and_limit():
    tokens = {"a": 1000, "b": 100, "c": 10, "d": 0}
    one = mixing.exponent_for(tokens, max_repeats=3.0)
    assert mixing.most_repeated(tokens, one) == pytest.approx(3.0)
    half = mixing.exponent_for(tokens, target_entropy=0.8)
    assert mixing.entropy(mixing.weights(tokens, half)) == pytest.approx(0.8)
    assert mixing.exponent_for(tokens, max_repeats=1.0) == pytest.approx(1.0) and mixing.exponent_for({}, max_repeats=2.0) == 0.0


@pytest.mark.parametrize("aims", [{"max_repeats": 3.0}, {"target_entropy": 0.8}, {"target_entropy": 5.0}, {"max_repeats": 2.0, "target_entropy": 0.9}, {}])
def test_plan_of_a_table_of_sources_equals_the_plain_formulas(spark, aims):
    tokens = {"a": 1000, "b": 100, "c": 10, "d": 0, "e": 777}
    totals = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    exponent = mixing.exponent_for(tokens, **aims)
    assert mixing.exponent_of(totals, **aims) == pytest.approx(exponent, abs=1e-9)
    weight = mixing.weights(tokens, exponent)
    budget = max(tokens[s] / w for s, w in weight.items() if w)
    for r in mixing.source_plan(totals, exponent, 50).collect():
        assert r.weight == pytest.approx(weight[r.source]) and r.n_blocks == max(tokens[r.source] // 50, 1)
        seen = weight[r.source] * budget if tokens[r.source] else 0
        assert r.whole_passes * tokens[r.source] + r.rest == pytest.approx(seen, abs=1e-5) and r.whole_passes >= 1
    assert mixing.exponent_of(totals.where("tokens = 0"), **aims) == mixing.exponent_for({}, **aims)


def test_exact_groups_equal_brute_force(spark):
    draw = random.Random(9)
    same_start = "p" * 300
    pool = [None, "", "a", "b", same_start + "x", same_start + "y", "é", "long " * 5000]
    rows = [(i, draw.choice(pool), "c", "h") for i in range(200)] + [(1000, "only one", "c", "h"), (1001, same_start + "only", "c", "h"), (None, "a", "c", "h")]
    rows += [(500, "twice", "c", "h")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, content_hash string")
    found = exact_dedup.exact_groups(docs).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = sorted(((i, max((x for x in groups[t or ""] if x is not None)), len(groups[t or ""])) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == want
    assert sum(r.kept for r in found) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((max(x for x in ids if x is not None), t) for t, ids in groups.items())
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_prefix_buckets_follow_the_rows(spark, monkeypatch):
    assert [exact_dedup.prefix_bits(n) for n in (0, 1, 1 << 19, (1 << 19) + 1, 1 << 24, 1 << 40)] == [1 << 22, 1 << 22, 1 << 22, 1 << 23, 1 << 27, 1 << 28]
    monkeypatch.setattr(exact_dedup, "PREFIX_BITS", 8)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 8)  # chance marks every bucket
    docs = table(spark, [f"text {i % 150:03d}" for i in range(200)])
    assert Counter(r.group_size for r in exact_dedup.exact_groups(docs).collect()) == {1: 100, 2: 100}
    marked = exact_dedup._repeated(spark.createDataFrame([(7,), (7,), (5000,), (5000,), (9,)], "k long"), F.col("k"), 1 << 20)
    held = exact_dedup._in_repeated(spark.createDataFrame([(7,), (9,), (5000,), (6000,), (-1,)], "k long"), F.col("k"), 1 << 20, marked)
    assert {r.k: r.held for r in held.collect()} == {7: True, 9: False, 5000: True, 6000: False, -1: False}


def test_hash_of_the_query_is_that_of_the_text(spark, sf_dir):
    from cinegrade.llm.catalog import op9_exact_dedup

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert all(r.text_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest() for r in op9_exact_dedup(spark, sf_dir).collect())


def test_arrow_batches_are_bounded_by_bytes(spark):
    from cinegrade.llm.common import BATCH_BYTES, prepare

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        for given, left in (("64m", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(setting, given)
            prepare(spark)
            assert spark.conf.get(setting) == left
    finally:
        spark.conf.set(setting, before)
