"""Toxicity, conversation repair and source divergence against plain versions on small tables."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cinegrade.llm import conversation_repair as repair
from cinegrade.llm import divergence_audit, pu_toxicity
from cinegrade.llm.catalog import held_out_rows

# Toxicity


def toxic_docs(n=400, seed=3):
    """Every fifth document has two words of a small vocabulary with changing ends."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("aeiourstln") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        body = [draw.choice(words) for _ in range(draw.randint(20, 60))]
        if i % 5 == 0:
            for _ in range(2):
                body.insert(draw.randint(0, len(body)), draw.choice(["wozzk", "grumpf"]) + draw.choice(["", "en", "ig", "ster"]))
        rows.append((i, " ".join(body), "clash", 0.5))
        if i % 3:
            labels.append((i, int(i % 5 == 0)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_docs()
    odd = [(1000, None, "x", 1.0), (1001, "", "x", 1.0), (1002, " 12 !", "x", 1.0), (1003, "wozzkig grumpfen " * 15_000, "x", 1.0), (1004, rows[0][1], "x", 1.0), (None, rows[1][1], "x", 1.0)]
    return (spark.createDataFrame(rows + odd, "doc_id long, text string, packed string, score double").cache(),
            spark.createDataFrame(labels + labels[:50] + [(None, 1), (7777, 1), (3, None)], "doc_id long, toxic int").cache())


def test_toxic_documents_are_found_without_their_labels(spark, toxic):
    docs, labels = toxic
    model = pu_toxicity.fit_toxicity(docs.where(~held_out_rows()), labels.where(~held_out_rows()))
    assert len(model) == pu_toxicity.MEMBERS
    found = pu_toxicity.predict(docs, model, held_out_rows()).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r for r in found}
    for i in range(400):
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= by_id[i].score <= 1 and by_id[i].predicted == int(by_id[i].score >= 0.3)
    right = [by_id[i].predicted == int(i % 5 == 0) for i in range(400) if by_id[i].held_out]
    assert np.mean(right) > 0.95
    assert by_id[1003].predicted == 1 and by_id[1004].score == by_id[0].score
    assert by_id[1000].score == by_id[1001].score == by_id[1002].score < 0.3
    again = pu_toxicity.fit_toxicity(docs.repartition(7).where(~held_out_rows()), labels.repartition(3).where(~held_out_rows()))
    assert again == model


def test_scores_are_the_mean_of_the_members(toxic):
    model = (pu_toxicity.Member((1, 5), (0.5, -0.25), 0.1), pu_toxicity.Member((5,), (2.0,), -1.0))
    for text in ("", "one two", "wozzk"):
        buckets = set(pu_toxicity.features(text).tolist())
        want = np.mean([1 / (1 + np.exp(-(m.bias + sum(w for b, w in zip(m.buckets, m.weights) if b in buckets)))) for m in model])
        assert pu_toxicity.scores([text], model)[0] == pytest.approx(want)


def test_the_risk_is_corrected_for_the_prior_and_does_not_fall_below_zero():
    z_t, z_u = np.array([2.0, -1.0]), np.array([0.5, -3.0, 1.0])
    on_toxic, on_clean = pu_toxicity.risk_parts(z_t, z_u, 0.2)
    assert on_toxic == pytest.approx(0.2 * np.mean(np.log1p(np.exp(-z_t))))
    assert on_clean == pytest.approx(np.mean(np.log1p(np.exp(z_u))) - 0.2 * np.mean(np.log1p(np.exp(z_t))))
    # one toxic text among few unlabelled ones: the fit must not run off on what it has seen
    toxic_rows = [np.array([k, 50]) for k in range(5)]
    unlabelled = [np.array([k + 10, 60]) for k in range(40)] + toxic_rows
    member = pu_toxicity.fit_member(toxic_rows, unlabelled, prior=0.1)
    raw = lambda rows: np.array([member.bias + sum(w for b, w in zip(member.buckets, member.weights) if b in r) for r in rows])
    assert raw(toxic_rows).min() > raw(unlabelled[:40]).max()
    assert pu_toxicity.risk_parts(raw(toxic_rows), raw(unlabelled), 0.1)[1] > -0.05


def test_toxicity_with_little_to_learn_from(spark, toxic):
    docs, labels = toxic
    nothing = pu_toxicity.fit_toxicity(docs, labels.where("toxic = 0"))
    assert nothing == () and {r.score for r in pu_toxicity.predict(docs, nothing, held_out_rows()).collect()} == {0.0}
    assert pu_toxicity.prior_of(labels.where("toxic = 1").selectExpr("doc_id as key", "toxic as target")) == pu_toxicity.ONLY_TOXIC
    few = pu_toxicity.fit_toxicity(docs, labels.where("doc_id in (5, 10, 1, 2, 4)"), max_unlabelled=50)
    assert len(few) == pu_toxicity.MEMBERS
    assert pu_toxicity.predict(docs.limit(0), few, held_out_rows()).count() == 0


# Conversations


def plain_faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.rstrip(" \t\n\r\x0b\x0c")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows):
    """Cheapest edits by uniform-cost search over whole edit strings, equal costs by string."""
    faults, heap, done = plain_faults(rows), [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, "\n".join(lines)
        state = (at, initials[-1:] if initials not in ("s",) else "s", not initials)
        if state in done:
            continue
        done.add(state)
        nxt = []
        for name in ("user", "assistant"):
            nxt.append((cost + 5, audit + "I", at, initials + name[0], lines + (f"{name}:",)))
        if at < len(rows):
            (role, text), fault = rows[at], faults[at]
            nxt.append((cost + 2, audit + "D", at + 1, initials, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                nxt.append((cost + more, audit + "K", at + 1, initials + (role[:1] or "?"), lines + (f"{role}:{text}",)))
                for name in ("user", "assistant"):
                    nxt.append((cost + 1 + more, audit + "R", at + 1, initials + name[0], lines + (f"{name}:{text}",)))
        for entry in nxt:
            if re.fullmatch("(s?(ua)*u?)?", entry[3]):
                heapq.heappush(heap, entry)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_report(rows):
    whole = defaultdict(list)
    for r in plain_damage(rows):
        whole[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(whole[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        turns = [r[1] for r in mine if r[1] is not None]
        faults = Counter(plain_faults([r[2:] for r in mine]))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = plain_repair([r[2:] for r in mine])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def odd_conversations(n=150, seed=5):
    draw, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(draw.randint(1, 7)):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"])
            text = draw.choice(["Yes.", "No! ", "cut off", None, "", " \t\n", "What?\n", "Yes.", "ümlaut.", "\xa0", "same " * 20 + draw.choice("ab")])
            rows.append((conv, draw.choice([turn, turn, turn + 3, None]), role, text))
            if draw.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_repair_equals_a_search_over_all_edits(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, place int").repartition(5)
    found = {r.conv_id: tuple(r)[1:] for r in repair.report(df, repair.damaged(df)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert found == plain_report(rows)


def test_repaired_rows_follow_the_grammar(spark):
    rows = [(k, t, r, x) for k, t, r, x in odd_conversations(40, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = defaultdict(list)
    for r in repair.repaired(df, repair.audits(df)).collect():
        whole[r.conv_id].append(r)
    assert whole
    for out in whole.values():
        out.sort(key=lambda r: r.position)
        assert [r.position for r in out] == list(range(len(out)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in out))
        assert all(r.text == "" for r in out if r.edit == "I")


def test_endings_are_shared_and_long_conversations_end():
    endings = repair.Endings()
    signs = sorted([b"AEI" * 5, b"EI" * 6, b"I" + b"EI" * 6, b"MEI" * 5], key=lambda s: s[::-1])
    found = {s: endings.read(s) for s in signs}
    assert endings.made < sum(map(len, signs))
    for s in signs:
        assert found[s] == repair.Endings().read(s)
    cost, audit = repair.Endings().read(b"EI" * 50_000)
    assert cost == 0 and audit == "K" * 100_000
    assert repair.Endings().read(b"") == (0, "")


def test_many_copies_of_a_row_and_an_empty_table(spark):
    rows = [(1, 0, "user", "Hello there.")] * 3000 + [(1, 1, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.report(df, df).first()
    assert (found.duplicate, found.cost, found.audit, found.illegal) == (2999, 2 * 2999, "K" + "D" * 2999 + "K", 2999)
    empty = df.limit(0)
    assert repair.report(empty, repair.damaged(empty)).count() == 0


# Divergence


def plain_audit(rows, least=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(r[1] or "", r[2] or "", [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[0] or "")]) for r in rows]
    held = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= least:
            kept[lang].append(t)
    counts = defaultdict(Counter)
    for lang, source, terms in docs:
        counts[lang, source].update(t for t in terms if held[lang, t] >= least)
    share = lambda n, c, v: 1 + 1_000_000_000 * (n + 2) // (sum(c.values()) + 2 * v)
    out = set()
    for (lang, source), mine in counts.items():
        terms, v = kept[lang], len(kept[lang])
        p = {t: share(mine[t], mine, v) for t in terms}
        pairs, told = [], []
        for (other_lang, other), theirs in counts.items():
            if other_lang == lang and other != source:
                q = {t: share(theirs[t], theirs, v) for t in terms}
                pairs.append((other, sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in terms)))
        together = sum((c for (g, _), c in counts.items() if g == lang), Counter())
        for t in terms:
            q = share(together[t], together, v)
            if mine[t] and p[t] > q:
                told.append((t, (p[t] - q) ** 2 // (p[t] + q)))
        for part, items, most in (("pair", pairs, None), ("term", told, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def audit_rows(seed=2, n=300):
    draw = random.Random(seed)
    stems = ["Ab", "abc", "abcd", "abcdefgh", "abcdefghijklmnopq", "é", "éa", "日本語", "x" * 40, "x" * 40 + "y", "zebra", "Zebras", "zebrafinch"]
    rows = []
    for _ in range(n):
        text = "".join(draw.choice(stems) + draw.choice(["", "s", " ", " ", "1", ". ", "\n"]) for _ in range(draw.randint(0, 25)))
        rows.append((draw.choice([text, text, text, text, None]), draw.choice(["en", "de", None, ""]), draw.choice(["s1", "s2", "s3", None, "s10"])))
    return rows + [rows[0]] * 30 + [("lone", "fr", "only"), ("", "it", "a"), (None, "it", "b"), ("word " * 50_000, "en", "s1")]


@pytest.mark.parametrize("sizes", [{}, {"first_width": 1, "terms": 5, "sources": 2}])
def test_audit_equals_exact_counting(spark, sizes):
    rows = audit_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(6)
    found = [tuple(r) for r in divergence_audit.audit(df, **sizes).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == plain_audit(rows)


def test_refinement_keeps_exactly_the_frequent_terms(spark):
    rows = audit_rows(seed=8)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    cut = divergence_audit.cut_documents(df)
    for least, width in ((1, 2), (10, 3), (60, 16)):
        held = Counter((r[1] or "", t) for r in rows for t in set(divergence_audit.terms_of((r[0] or "").encode())))
        found = [(r.lang, bytes(r.term)) for r in divergence_audit.kept_terms(cut, least, width).collect()]
        assert sorted(found) == sorted(k for k, n in held.items() if n >= least)


def test_audit_of_an_empty_table(spark):
    assert divergence_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
