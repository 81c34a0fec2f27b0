"""Personal data: patterns against plain regular expressions, disclosure against counts in dictionaries."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetspark.llm import registry, sanitise
from fleetspark.llm.personal_data import KINDS, base_spans, luhn
from fleetspark.llm.terms import PASSAGE, term_blocks

registry.load_all()
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _ok(kind, found):
    digits = "".join(c for c in found if c in "0123456789")
    if kind == 1:
        return all(int(p) <= 255 for p in found.split("."))
    if kind == 2:
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def naive_spans(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if _ok(k, m[0]))


def _joined(spans):
    return ",".join(f"{k if isinstance(k, str) else KINDS[k]}:{a}:{b}" for a, k, b in spans)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.-+ 0149()%é\n", max_size=40) | st.text(alphabet="@.a", max_size=25) | st.text(alphabet="12. 5", max_size=30)
       | st.text(alphabet="+1 -(49", max_size=40))
def test_patterns(text):
    assert base_spans(text) == naive_spans(text)


def test_long_digits_and_addresses():
    for text in ("1" * 50_000, "1." * 30_000, "a" * 50_000 + "@", "@".join(["ab"] * 9_000), "+1" + "(" * 50_000, "4 " * 30_000, "256.1.1.1 0255.1.1.1"):
        base_spans(text)
    assert base_spans("0255.001.1.1") == [(0, 1, 12)] and base_spans("256.1.1.1") == [] and luhn("4111111111111111")


def _card(rng):
    while True:
        number = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(number):
            return number


def make_rows(seed=4):
    """Numbers after "card", some of them no cards; a name that only ever stands beside one address; prose around."""
    rng = random.Random(seed)
    prose = ["".join(rng.choice("aeioubdkrst") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    rows = []
    for i in range(220):
        words = [rng.choice(prose) for _ in range(rng.randint(5, 90))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), _card(rng))
        if i % 9 == 0:
            words.insert(rng.randrange(len(words)), f"{rng.choice('bcd')}{i}@mail{i % 4}.example.com,")
        if i % 11 == 0:
            at = rng.randrange(len(words))
            words[at:at] = ["Zoltan-7;", "boss@corp.example.org", "zoltan-7"]
        if i in (3, 8):
            words.insert(2, "1234567890123456")
        if i == 12:
            words += ["é" * 3, "+1 (269) 555-3296 4524132264652876", "ZOLTAN-7"]
        text = " ".join(words)
        rows.append((i, text.replace(" ", "\n", 1) if i % 3 else text))
    return rows + [(1, rows[0][1])] * 4 + [(None, rows[5][1]), (500, None), (501, ""), (502, " \n\t"), (503, "... !!!"), (504, "x" * 3000)]


def _terms(text):
    """(start, end, term, shape or None, passage) of every word, by the definition."""
    out, base = [], 0
    for line in text.split("\n"):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", line))
        for lo in range(0, len(words), PASSAGE):
            part = words[lo:lo + PASSAGE]
            passage = _small(line[part[0].start():part[-1].end()])
            for m in part:
                word = m[0].rstrip(".,;:!?")
                if word:
                    shape = None
                    if re.search("[0-9]", word):
                        shape = re.sub("[A-Za-z\x80-\U0010ffff]+", "a", re.sub("[0-9]", "9", word))
                    out.append((base + m.start(), base + m.start() + len(word), _small(word), shape and "shape " + shape, passage))
        base += len(line) + 1
    return out


def _small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_force(rows, threshold):
    """Counter of (doc_id, base spans, [(start, end, general)])."""
    passages, holding, together, evidence = set(), defaultdict(set), defaultdict(set), defaultdict(set)
    for text in {t for _, t in rows if t}:
        terms = _terms(text)
        members = defaultdict(set)
        for _, _, term, shape, passage in terms:
            members[passage] |= {term, shape} - {None}
        passages |= members.keys()
        for passage, own in members.items():
            for t in own:
                holding[t].add(passage)
        for a, k, b in naive_spans(text):
            found = text[a:b]
            value = KINDS[k] + (found.lower() if k < 2 else re.sub("[^0-9]", "", found))
            for passage in {p for s, e, _, _, p in terms if s < b and e > a}:
                for entity, proof in ((k, value), (value, passage)):
                    evidence[entity].add(proof)
                    for t in members[passage]:
                        together[entity, t].add(proof)
    n, strong = len(passages), set()
    for (entity, t), proofs in together.items():
        n_e, n_t = len(evidence[entity]), len(holding[t])
        m, k = min(len(proofs), n_t), min(n_e, n_t)
        if n > n_e:
            share = m / (m + 1) * k / (k + 1) * math.log2(m * n / (n_e * n_t)) / math.log2(n / n_e)
            assert abs(share - threshold) > 1e-9
            if share >= threshold:
                strong.add(t)
    out = Counter()
    for doc_id, text in rows:
        spans = naive_spans(text)
        found = tuple((s, e, shape is not None and shape not in strong) for s, e, term, shape, _ in _terms(text or "")
                      if (term in strong or shape in strong) and not any(s < b and e > a for a, _, b in spans))
        out[doc_id, _joined(spans), found] += 1
    return out


@pytest.mark.parametrize("threshold", [0.85, 0.7, 0.4])
def test_disclosing_terms(spark, threshold):
    rows = make_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, doc_id long, text string").repartition(3)
    got = sanitise.find(spark, df, threshold).collect()
    mine = Counter((r.doc_id, r.base, tuple((f.start, f.end, f.general) for f in r.found)) for r in got)
    expected = brute_force(rows, threshold)
    assert mine == expected
    assert any(found for _, _, found in expected)


def test_rare_numbers_follow_their_shape(spark):
    """A number that fails the card check is found by its shape; prose and clean texts stay."""
    rows = make_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", sanitise.F.lit("kept"))
    got = {r.doc_id: r for r in sanitise.sanitised(spark, df).collect()}
    assert all("1234567890123456" not in got[i].text and "<removed>" in got[i].text for i in (3, 8))
    assert got[500].text is None and got[501].text == "" and got[502].text == " \n\t" and got[3].base == "kept"
    assert "<card>" in got[0].text and "<email>" in got[9].text
    # id 1 stands for several texts
    clean = [i for i, t in rows[:220] if not naive_spans(t) and i not in (1, 3, 8, 12)]
    assert len(clean) > 100 and all(got[i].text == rows[i][1] for i in clean)


def test_query(spark, sf, docs):
    rows = registry.QUERIES["op11_personal_data"](spark, sf).collect()
    expected = Counter()
    for (doc_id, base, found), times in brute_force([(d, t) for d, t, *_ in docs], sanitise.THRESHOLD).items():
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        spans = sorted([(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                       + [(s, 4, e) for s, e, _ in found])
        listed = ",".join(f"{(*KINDS, 'term')[k]}:{a}:{b}" for a, k, b in spans)
        general = sum(g for *_, g in found)
        expected[(doc_id, *[kinds.count(k) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), listed,
                  general, len(found) - general)] += times
    assert Counter(map(tuple, rows)) == expected


def test_generalised_or_removed():
    text = "call Room-12 of ann@x.example.org now"
    assert sanitise.replaced(text, "email:16:33", [(5, 12, True), (34, 37, False)]) == "call a-99 of <email> <removed>"
    assert sanitise.replaced(text, "", []) == text


def test_long_texts_come_in_blocks():
    rng = random.Random(2)
    text = "\n".join(" ".join(rng.choice(["ab", "é1", "c3-4.", "..", "X"]) for _ in range(rng.randint(1, 70))) for _ in range(6000))
    got = [(int(s), int(e)) for found in term_blocks(["", text, "z"]) for r, s, e in zip(found.row, found.start, found.end) if r == 1]
    assert got == [(s, e) for s, e, *_ in _terms(text)]
