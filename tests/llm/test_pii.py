import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridtide.llm import pii
from gridtide.llm.queries import personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    found = [
        (m.start(), at, m.end(), kind)
        for at, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def spans(docs):
    found = pii.detect(docs).select("doc_id", pii.span_text("base").alias("s")).collect()
    return sorted(((r.doc_id, r.s) for r in found), key=repr)


def expected(rows):
    return sorted(((i, ",".join(plain(t))) for i, t in rows), key=repr)


def test_query(spark, small, small_rows):
    texts = dict(small_rows)
    rows = personal_data(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == base


def test_edges(edge_docs, edge_rows):
    assert spans(edge_docs) == expected(edge_rows)


def test_empty_table(no_docs):
    assert pii.detect(no_docs).collect() == []
    assert pii.sanitise(no_docs).collect() == []


HARD = [
    "a@b.co_x@c.de", "a@b.c@d.e", "a.b@c-d.e-f.g h@i", "@x.y a@.b a@b. x@y.z.", "é@b.co ñ1@ü.com", "a@b..c@d.ee",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.00.1.1", "000000000000000000000000000000000000000001.1.1.1", "1.2.3 4.5.6.7",
    "4111 1111 1111 1111", "4111-1111-1111-1111x4111111111111111", "4111  1111 1111 1111", "1 2", "41111111111111111111111",
    "+1 (456) 555-2186", "+14565552186+14565552186", "+1", "+1 2", "++12345678901)", "+1 234567890123456", "\U0001f600 +49 30 1234567 \U0001f600 1.1.1.1",
]


def test_hard_cases(spark):
    rows = list(enumerate(HARD))
    assert spans(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected(rows)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab.@_-+1234 ()é", max_size=60), min_size=30, max_size=60))
def test_random_texts(spark, texts):
    rows = list(enumerate(texts))
    assert spans(spark.createDataFrame(rows, "doc_id bigint, text string")) == expected(rows)


@pytest.fixture(scope="module")
def leaky(spark):
    """A word that stands only beside one address gives it away; common words do not."""
    rows = [(i, f"the project zanzibar belongs to boss@corp.example and number {'abcdefghij'[i]}") for i in range(6)]
    rows += [(100 + i, f"the weather is fine and number {'abcdefghij'[i % 10]} belongs to project {chr(97 + i) * 5}") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_disclosing_terms(leaky):
    found = {r.doc_id: {t.value for t in r.terms} for r in pii.detect(leaky).collect()}
    assert all("zanzibar" in found[i] for i in range(6))
    assert not any("project" in terms or "the" in terms for terms in found.values())
    assert all(not found[i] for i in range(100, 120))


def test_sanitise(leaky):
    texts = {r.doc_id: r.text for r in pii.sanitise(leaky).collect()}
    assert texts[0] == "the project  belongs to [EMAIL] and number a"
    assert texts[100] == "the weather is fine and number a belongs to project aaaaa"


def test_sanitise_keeps_rows_and_columns(edge_docs, edge_rows):
    out = pii.sanitise(edge_docs)
    assert out.columns == edge_docs.columns
    rows = out.collect()
    assert len(rows) == len(edge_rows)
    assert sum(r.text is None for r in rows) == 2
    assert all(r.key == "k" and r.terms == "t" for r in rows)
    nine = next(r.text for r in rows if r.doc_id == 9)
    assert "[EMAIL]" in nine and "[CARD]" in nine and "[PHONE]" in nine and "[IP]" in nine and "4111" not in nine


def test_terms_far_from_the_entity(spark):
    """A revealing word stands anywhere in the text; all of its occurrences go, those in base spans do not."""
    fill = " ".join(["of the weather and of other things"] * 12)
    rows = [(i, f"boss@corp.example {fill} Zanzibar {'abcdefghij'[i]} {fill} zanzibar") for i in range(6)]
    rows += [(100 + i, f"the {fill} number {chr(97 + i) * 5} boss") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: [(t.start, t.end, t.value) for t in r.terms] for r in pii.detect(docs).collect()}
    for i, text in rows:
        places = [(m.start(), m.end(), m.group()) for m in re.finditer("(?i)zanzibar", text)]
        assert found[i] == places
    texts = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert texts[0] == f"[EMAIL] {fill}  a {fill} "
    assert texts[100] == dict(rows)[100]


def rebuilt(text, low_high_word):
    """Plain loop: the text with words for spans that start where no earlier one reaches."""
    out, at = "", 0
    for low, high, word in low_high_word:
        if low >= at:
            out += text[at:low] + word
        at = max(at, high)
    return out + text[at:]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(1, 1400)), max_size=12), st.integers(3000, 5000))
def test_pieces_equal_a_plain_loop(spark, parts, size):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) for i in range(size))
    found = sorted((low, low + length) for low, length in parts)
    frame = spark.createDataFrame([(text, found)], "text string, spans array<struct<start:int,end:int>>")
    words = "transform(spans, (s, i) -> struct(s.start AS start, s.end AS end, concat('<', i, '>') AS word))"
    done = frame.selectExpr("text", "spans", f"{words} AS named").select(
        pii._blanked(F.col("text"), F.col("spans")), pii._replaced(F.col("text"), F.col("named"))
    )
    blanked, replaced = done.first()
    covered = {i for low, high in found for i in range(low, high)}
    assert blanked[:size] == "".join(" " if i in covered else c for i, c in enumerate(text))
    assert replaced == rebuilt(text, [(low, high, f"<{i}>") for i, (low, high) in enumerate(found)])


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 5, 8, 9, 1000])
def test_running_sums(spark, count):
    frame = spark.createDataFrame([([i % 7 for i in range(count)],)], "v array<int>")
    sums, most = frame.select(pii._running(F.col("v"), lambda x, y: x + y), pii._running(F.col("v"), F.greatest)).first()
    assert sums == [sum(i % 7 for i in range(k + 1)) for k in range(count)]
    assert most == [max(i % 7 for i in range(k + 1)) for k in range(count)]


def test_texts_with_very_many_matches_take_linear_time(spark):
    """A log of 32,000 addresses in 352 KB, and one ten times as long."""
    seconds = {}
    for count in (3_200, 32_000, 320_000):
        text = "".join(f"1.2.3.{i % 100:02d} xx" if i % 2 else f"a{i % 10000:04d}@b.co " for i in range(count))
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        start = time.monotonic()
        found = docs.select(pii.base_spans(F.col("text")).alias("s")).selectExpr("size(s)", "s[0]", "s[1]").first()
        clean = docs.select(pii._replaced(F.col("text"), F.expr(f"transform(sequence(0, {count - 1}), i -> struct(i * 11 AS start, i * 11 + 9 AS end, 'X' AS word))"))).first()[0]
        seconds[count] = time.monotonic() - start
        assert found[0] == count and (found[1].start, found[2].start) == (0, 11) and clean.count("X") == count
    assert seconds[32_000] < 6 and seconds[320_000] < 25 * seconds[32_000]


def test_sanitising_a_text_of_very_many_matches(spark):
    text = " ".join(f"user{i}@mail.example" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id bigint, text string")
    start = time.monotonic()
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean == {1: " ".join(["[EMAIL]"] * 20_000), 2: None, 3: "none"}
    assert time.monotonic() - start < 40


def test_term_statistics_equal_a_plain_count(spark):
    """The disclosing words of random corpora, from n(e), n(t) and n(e,t) counted document by document."""
    for seed in range(3):
        random = np.random.default_rng(seed)
        docs = []
        for i in range(120):
            who = int(random.integers(0, 12))
            words = [f"term{chr(97 + who % 26)}{chr(97 + (who * 7) % 26)}"] * bool(random.random() < 0.95)
            words += [f"noise{chr(97 + int(k))}" for k in random.integers(0, 8, 4)]
            random.shuffle(words)
            entity = f" who{who}@x.org" * bool(random.random() < 0.8)
            docs.append((i, f"{' '.join(words)} {i}{entity}"))
        frame = spark.createDataFrame(docs, "doc_id bigint, text string")
        found = {r.doc_id: {(t.value, t.removed) for t in r.terms} for r in pii.detect(frame).collect()}
        entities = {i: {m.lower() for m in re.findall(PATTERNS["email"].replace("(", "(?:"), t)} for i, t in docs}
        terms = {i: {w for w in re.findall(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], " ", t).lower())} for i, t in docs}
        total = len(docs)
        n_e = Counter(e for s in entities.values() for e in s)
        n_t = Counter(w for s in terms.values() for w in s)
        both = Counter((e, w) for i in terms for e in entities[i] for w in terms[i])
        wanted = {i: set() for i, _ in docs}
        for i in terms:
            for w in terms[i]:
                shares = []
                for e in entities[i]:
                    information = math.log(total / n_e[e])
                    if n_e[e] >= pii.SUPPORT and both[e, w] >= pii.SUPPORT and information > 0:
                        shares.append(math.log(both[e, w] * total / (n_e[e] * n_t[w])) / information)
                if shares and max(shares) >= pii.GENERALISE - 1e-12:
                    wanted[i].add((w, max(shares) >= pii.REMOVE - 1e-12))
        assert found == wanted and any(wanted.values())
