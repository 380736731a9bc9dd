import random
import re

import pytest

from spanlens.llm.license_scan import BASE, TEMPLATES, TEXTS, LicenseScanner, SuffixAutomaton, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_base(text):
    line, out = words(text), []
    for phrase, label in BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(line) - len(p) + 1) if line[i : i + len(p)] == p]
    return len(line), sorted(out)


def texts(seed):
    rng = random.Random(seed)
    vocab = sorted({w for _, t in TEMPLATES for w in t.split()}) + ["äpfel", "x1"]
    out = [None, "", "MIT License", "mit license mit license", "mit, license", "mit é license", "general public", "The GNU General Public License", "apache license general public license"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 12)):
            kind = rng.random()
            parts.append(" ".join(rng.choices(vocab, k=rng.randint(1, 20))) if kind < 0.5 else rng.choice(TEMPLATES)[1].title() if kind < 0.8 else rng.choice(BASE)[0])
        out.append(rng.choice([" ", ", "]).join(parts))
    return out + ["mit license " * 9000]


def test_base_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(1))] + [(None, "mit license"), (3, texts(1)[3])]
    docs = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, base string, score double")
    got = sorted((str((r.doc_id, r.n_words, [tuple(b) for b in r.base])) for r in scan_licenses(docs).collect()))
    assert got == sorted(str((d, *slow_base(t))) for d, t in rows)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    lines = [[rng.randint(1, 4) for _ in range(rng.randint(2, 25))] for _ in range(6)]
    sam = SuffixAutomaton(lines)
    parts = {tuple(x[i:j]) for x in lines for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    assert sum(sam.length[s] - sam.length[sam.link[s]] for s in range(1, len(sam.next))) == len(parts)
    for part in parts:
        ends = {(k, i + len(part)) for k, x in enumerate(lines) for i in range(len(x) - len(part) + 1) if tuple(x[i : i + len(part)]) == part}
        assert set(sam.ends[sam.find(list(part))]) == ends
    text = [rng.randint(1, 5) for _ in range(300)]
    state = size = 0
    for i, symbol in enumerate(text):
        while state and symbol not in sam.next[state]:
            state = sam.link[state]
            size = sam.length[state]
        if symbol in sam.next[state]:
            state, size = sam.next[state][symbol], size + 1
        assert size == max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in parts))


@pytest.mark.parametrize("k", range(len(TEMPLATES)))
def test_each_template_is_found_whole_and_with_a_changed_word(k):
    label, text = TEMPLATES[k]
    scanner = LicenseScanner()
    line = words(text)
    _, _, spans = scanner.scan(f"some words before {text.upper()}. after it".encode())
    mine = [s for s in spans if s[0] == scanner.n_base + k]
    assert [(s[1], s[2], s[3]) for s in mine] == [(3, 3 + len(line), 1.0)]
    if len(line) >= 15:
        changed = [*line[:7], "otherword", *line[8:]]
        _, _, spans = scanner.scan(" ".join(changed).encode())
        assert [s[3] for s in spans if s[0] == scanner.n_base + k] == [pytest.approx(1 - 1 / len(line))]
        assert not [s for s in scanner.scan(" ".join(line[: len(line) // 2]).encode())[2] if s[0] == scanner.n_base + k]


def slow_spans(text, k):
    """Spans of one template: all longest common runs by comparing words, all chains of them."""
    line, own = words(text), words(TEMPLATES[k][1])
    runs = set()
    for i in range(len(line)):
        longest = max((n for j in range(len(own)) for n in range(1, len(own) - j + 1) if line[i : i + n] == own[j : j + n]), default=0)
        if longest >= 3 and not any(a <= i and i + longest <= b for a, b, _, _ in runs):
            runs |= {(i, i + longest, j, j + longest) for j in range(len(own)) if line[i : i + longest] == own[j : j + longest]}
    runs = sorted(runs)
    best = []
    for n, (ts, te, ps, pe) in enumerate(runs):
        top = (te - ts, ts)
        for m, (a, b, c, d) in enumerate(runs[:n]):
            more = min(te - max(ts, b), pe - max(ps, d))
            if a < ts and c < ps and ts - b <= 8 and ts - a <= 8 + len(own) and more > 0 and best[m][0] + more >= top[0]:
                top = max(top, (best[m][0] + more, best[m][1]), key=lambda x: x[0])
        best.append(top)
    enough = [(start, -cover / len(own), r[1]) for r, (cover, start) in zip(runs, best) if cover >= 0.8 * len(own)]
    out, to = [], -1
    for start, cover, stop in sorted(enough):
        if start >= to:
            out.append((start, stop, min(1.0, -cover)))
            to = stop
    return out


def test_chained_spans_equal_brute_force():
    rng = random.Random(11)
    scanner = LicenseScanner()
    found = 0
    for trial in range(60):
        k = rng.randrange(len(TEMPLATES))
        line = words(TEMPLATES[k][1])
        for _ in range(rng.randint(0, 1 + len(line) // 12)):
            at = rng.randrange(len(line))
            line[at : at + rng.randint(0, 2)] = rng.choices(["odd", "words", line[at], "software", "the"], k=rng.randint(0, 2))
        text = " ".join([*rng.choices(["to", "the", "license", "mit", "x"], k=6), *line, "end", *words(TEMPLATES[rng.randrange(len(TEMPLATES))][1])[:9]])
        got = scanner.scan(text.encode())[2]
        for j in {k, *rng.sample(range(len(TEMPLATES)), 3)}:
            want = slow_spans(text, j)
            found += len(want)
            assert [(a, b, pytest.approx(c)) for t, a, b, c in got if t == scanner.n_base + j] == want, (text, TEMPLATES[j])
    assert found > 30


def test_a_notice_within_a_longer_quote():
    mit = " ".join(words(TEXTS[0][1])[:40])
    labels = {LicenseScanner().labels[k] for k, *_ in LicenseScanner().scan(mit.encode())[2]}
    assert labels == {"mit"}
    three = dict(TEXTS)["bsd-3-clause"]
    assert {LicenseScanner().labels[k] for k, *_ in LicenseScanner().scan(three.encode())[2]} >= {"bsd-3-clause", "bsd"}


def test_clean_text_has_no_span(spark):
    docs = spark.createDataFrame([(1, "a plain text about the use of this and that, to the person in the field")], "doc_id long, text string")
    row = scan_licenses(docs).first()
    assert row.base == [] and row.spans == [] and row.score == 0.0
    assert scan_licenses(docs.limit(0)).collect() == []
