import random
import re

from tidewright.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(text):
    words = WORD.findall((text or "").translate(lower))
    places = [(i, lab) for p, lab in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places)


def as_regex(template):
    """The template over words joined by single spaces, each word followed by one."""
    out = ""
    for t in re.findall(r"\[\[|\]\]|\{\w+:\d+\}|[^\s\[\]]+", template):
        out += "(?:" if t == "[[" else ")?" if t == "]]" else r"(?:\S+ ){0,%d}" % int(t[1:-1].split(":")[1]) if t[0] == "{" else re.escape(t) + " "
    return re.compile(out)


def test_phrases_against_brute_force():
    rnd = random.Random(4)
    parts = ["MIT", "mit", "license", "License,", "apache", "general", "PUBLIC", "é", "\n", "-", "x"]
    known, autos = {p.encode(): v for p, v in L.PHRASES.items()}, {}
    for _ in range(2000):
        t = " ".join(rnd.choices(parts, k=rnd.randrange(30)))
        n, places, _ = L.scan(t.encode(), known, autos)
        assert (n, places) == brute(t)


def test_automata_accept_what_the_template_means():
    rnd = random.Random(5)
    for template in [*L.TEMPLATES.values(), "a [[b {x:2} c]] d {y:3} e", "a [[b]] [[c]] a"]:
        rx, auto = as_regex(template), L.Automaton(template)
        vocab = [w for w in re.findall(r"[^\s\[\]{}]+", template) if ":" not in w] + ["other"]
        for _ in range(300):
            words = []
            for t in re.findall(r"\[\[.*?\]\]|\{\w+:\d+\}|[^\s\[\]]+", template):
                if t[:2] == "[[":
                    words += [w for w in t[2:-2].split() if w[0] != "{"] if rnd.random() < 0.5 else []
                elif t[0] == "{":
                    words += rnd.choices(vocab, k=rnd.randrange(4))
                else:
                    words.append(t)
            if rnd.random() < 0.5:
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            words += ["tail"]
            assert (auto.accepts([w.encode() for w in words], 0) >= 0) == bool(rx.match("".join(w + " " for w in words)))


MIT = """The MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_whole_licences_need_all_of_their_wording(spark):
    texts = ["before " + MIT + " behind", MIT.replace("substantial", "large"), MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "Example Company"), MIT.replace("CLAIM, ", "")]
    out = L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (sorted({m.label for m in r.matches}), r.score) for r in out}
    assert got == {0: (["mit", "mit-grant"], 1.0), 1: (["mit-grant"], 0.75), 2: (["mit", "mit-grant"], 1.0), 3: (["mit-grant"], 0.75)}


def test_rows(spark):
    rows = [(1, "Released under the MIT License.", "a"), (1, "Released under the MIT License.", "a"), (2, None, "b"), (3, "", None), (None, "Apache  License", "c"), (4, "x " * 100_000 + "mit license", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, places string")
    out = L.license_scan(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.places), [m.label for m in r.matches], r.score) for r in out) == [
        (0, 2, 1, [], 0.5),
        (1, 5, 1, ["mit-notice"], 0.75),
        (1, 5, 1, ["mit-notice"], 0.75),
        (2, 0, 0, [], 0.0),
        (3, 0, 0, [], 0.0),
        (4, 100_002, 1, [], 0.5),
    ]
    assert L.license_scan(df.limit(0)).count() == 0
