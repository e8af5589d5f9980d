"""License scans against every template for every segment."""

import re

from tessera.llm import licenses as L

WORD_ANY = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))


def brute(text, templates, threshold):
    text = text or ""
    grams = lambda w: set(zip(w, w[1:]))
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text) if words(m.group())]
    paragraphs, held = [], []
    for m in re.finditer(r"([^\n]*)(\n|$)", text):
        if words(m[1]):
            held.append((m.start(1), m.end(1)))
        if not m[1].strip(" \t\r\x0b\x0c") and held:
            paragraphs.append(held)
            held = []
    paragraphs += [held] if held else []
    segments = lines + [(p[0][0], p[-1][1]) for p in paragraphs if len(p) > 1]
    if len(paragraphs) > 1:
        segments.append((lines[0][0], lines[-1][1]))
    out = []
    for a, b in segments:
        own, best = grams(words(text[a:b])), None
        for name, t in templates.items():
            other = grams(words(t))
            if own and other:
                d = 2 * len(own & other) / (len(own) + len(other))
                if d >= threshold and (best is None or (-d, name) < (-best[1], best[0])):
                    best = (name, d)
        if best:
            out.append((*best, a, b))
    found = [(m.start(), m.end()) for m in WORD_ANY.finditer(text)]
    w, inner, taken = words(text), [], []
    for name, t in templates.items():
        other, size = grams(words(t)), len(words(t))
        for i in range(len(w) - 1):
            if (w[i], w[i + 1]) in other:
                own = grams(w[i:i + size])
                d = 2 * len(own & other) / (len(own) + len(other))
                if d >= threshold:
                    inner.append((-len(own & other), -d, i, name, min(i + size, len(w))))
    for _, d, i, name, j in sorted(inner):
        if all(j <= a or b <= i for a, b in taken):
            taken.append((i, j))
            a, b = found[i][0], found[j - 1][1]
            if all(b <= x[2] or x[3] <= a for x in out if x[4:] == ()):
                out.append((name, -d, a, b, "window"))
    out = [x[:4] for x in out]
    return len(segments), sorted(out, key=lambda x: x[2:])


def check(df, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    got = sorted(((r.doc_id, r.n_segments, [tuple(m) for m in r.matches]) for r in L.scan(df, templates=templates, threshold=threshold).collect()), key=repr)
    want = sorted(((r.doc_id, *brute(r.text, templates, threshold)) for r in df.collect()), key=repr)
    assert got == want
    return sum(len(m) for _, _, m in got)


def test_documents(documents):
    assert check(documents) > 0


def test_odd_rows_and_templates(odd, none, spark):
    check(odd)
    check(none)
    few = {"b": "one two three", "a": "One, two; three", "single": "one", "empty": "", "delta": "délta ép"}
    assert check(odd, few, 0.5) > 0


def test_full_texts(spark):
    mit = L.TEMPLATES["MIT-text"]
    at = len(mit) // 2
    at = mit.index(" ", at)
    rows = [(1, "Intro é line\n\n" + mit[:at] + "\n" + mit[at + 1:] + "\n\nend of it"), (2, mit.upper().replace(",", " ,")),
            (3, mit.replace("Software", "Program")), (4, " ".join(mit.split()[::-1])), (5, L.TEMPLATES["Apache-2.0"] + "\n" + L.TEMPLATES["MIT"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    got = {r.doc_id: [(m.template, m.first, m.end) for m in r.matches] for r in L.scan(df).collect()}
    assert got[1] == [("MIT-text", 0, 25 + len(mit)), ("MIT-text", 14, 14 + len(mit))] and got[2][0][0] == "MIT-text" and got[4] == []
    assert [m[0] for m in got[5]] == ["Apache-2.0", "MIT"]


def test_notices_within_lines_and_across_blank_lines(spark):
    """Recall of templates put into prose, some with a word changed; prose alone matches nothing."""
    prose = "ép the cat sat on the mat and it was late in the year when all of them went to the old house by the river".split()
    rows, want = [], {}
    for k, (name, t) in enumerate(sorted(L.TEMPLATES.items())):
        rows.append((2 * k, " ".join(prose) + ". " + t + " " + " ".join(prose[::-1])))
        w = t.split()
        half = len(w) // 2
        w[half] = w[half] if len(w) < 20 else "changed"
        rows.append((2 * k + 1, " ".join([*prose, *w[:half]]) + "\n\n" + " ".join([*w[half:], *prose])))
        want[2 * k] = want[2 * k + 1] = name
    rows += [(1000, "Our tool is released under the MIT License. See the docs for more."),
             (1001, "It was printed in May. Licensed under the Apache License, Version 2.0. Enjoy it."), (1002, " ".join(prose * 50))]
    want |= {1000: "MIT", 1001: "Apache-2.0"}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    got = {r.doc_id: [m.template for m in r.matches] for r in L.scan(df).collect()}
    assert got[1002] == [] and got[1000] == ["MIT"] and got[1001] == ["Apache-2.0"]
    assert sum(name in got[d] for d, name in want.items()) >= 0.9 * len(want)


def test_pruning_loses_no_match():
    known = L.Templates(L.TEMPLATES, 0.6)
    for t in L.TEMPLATES.values():
        w = L.words_of(t.encode())
        for drop in range(0, len(w), 3):
            own = w[:drop] + w[drop + 1:]
            best = max(((2 * len(L.bigrams(own) & b) / (len(L.bigrams(own)) + n), name) for n, name, b in known.rows), default=(0, ""))
            assert (known.best(own) is not None) == (best[0] >= 0.6)
