import random
from pathlib import Path

import numpy as np
import pytest

from canvass.llm import licenses as li
from canvass.llm.common import table

INDEX = li.Index(li.TEMPLATES)


def brute(template, words):
    """Longest common subsequence of the template and the whole text."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(words):
            new.append(row[j] + 1 if t == w else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_equals_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(150):
        template = np.array([rng.randrange(12) for _ in range(rng.randrange(3, 15))])
        copy = [w for w in template.tolist() for w in ([w] if rng.random() < 0.9 else [w, 99])]
        before = [50] * rng.randrange(6)
        text = np.array(before + copy + [51] * rng.randrange(6))
        matched, first, last = li.align(template, text, len(before), 40)
        assert matched == brute(template.tolist(), text.tolist())
        assert brute(template.tolist(), text[first:last].tolist()) == matched


def test_any_shared_run_shares_a_fingerprint():
    rng = random.Random(3)
    for _ in range(200):
        run = [rng.randrange(1000) for _ in range(li.GRAM + li.WINDOW - 1)]
        a, b = (np.array([rng.randrange(1000) for _ in range(rng.randrange(8))] + run + [rng.randrange(1000) for _ in range(rng.randrange(8))]) for _ in range(2))
        ga, gb = li.grams(a), li.grams(b)
        assert set(ga[li.fingerprints(ga)].tolist()) & set(gb[li.fingerprints(gb)].tolist())


def test_templates_and_edits():
    scan = li.Scanner(INDEX, li.COVERAGE)
    for name, text in li.TEMPLATES.items():
        doc = f"Some words ahead.\n{text}\nand after é."
        got = scan(doc)
        assert [g[0] for g in got] == [name] and got[0][1] == 1 and doc[got[0][4]:got[0][5]] == text
    edited = li.TEMPLATES["MIT-text"].replace("free of charge", "without any charge").upper()
    assert [(g[0], g[1] > 0.9) for g in scan(edited)] == [("MIT-text", True)]
    twice = scan(li.TEMPLATES["MIT"] + " x y z " + li.TEMPLATES["MIT"] + " " + li.TEMPLATES["GPL-3.0"])
    assert [g[0] for g in twice] == ["MIT", "MIT", "GPL-3.0"]
    assert scan("the terms of the work under the license of words") == [] == scan(None) == scan("") == scan("a b")


def test_against_lines_of_the_corpus(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = li.scan(docs).collect()
    lines = {"GPL-3.0": "GNU General Public License, version 3.", "CC-BY-NC-4.0": "under CC BY-NC 4.0.", "MIT": "under the MIT License.", "Apache-2.0": "Apache License, Version 2.0."}
    rows = docs.collect()
    for name, line in lines.items():
        assert sorted(r.doc_id for r in got if r.license == name) == sorted(r.doc_id for r in rows for _ in range(r.text.count(line)))


def test_edges(spark):
    docs = spark.createDataFrame([(None, li.TEMPLATES["MIT"], 1), (1, None, 1), (2, "", 1), (3, "x " * 200_000 + li.TEMPLATES["MIT"], 1), (3, li.TEMPLATES["MIT"], 1), (3, li.TEMPLATES["MIT"], 1)],
                                 "doc_id long, text string, license int")
    got = li.scan(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "3", "None"] and max(r.start for r in got) == 400_000
    assert li.scan(docs.limit(0)).count() == 0
    assert li.scan(docs, {}).count() == 0


def test_commented_headers_and_short_variants():
    scan = li.Scanner(INDEX, li.COVERAGE)
    words = li.TEMPLATES["Apache-2.0-header"].split()
    lines = [" ".join(words[k: k + 5]) for k in range(0, len(words), 5)]
    for mark in ("# ", "// ", " * "):
        assert [(g[0], g[1]) for g in scan("\n".join(mark + x for x in lines))] == [("Apache-2.0-header", 1.0)]
    numbered = scan(" ".join(f"{k} {x}" for k, x in enumerate(lines)))  # a word more every five words
    assert [(g[0], g[1]) for g in numbered] == [("Apache-2.0-header", 1.0)]
    assert [g[0] for g in scan("Released under an MIT License")] == ["MIT"]
    long = " ".join(f"w{k}" for k in range(200))
    drift = " ".join(f"w{k}" + " x" * (k % 5 == 0) for k in range(200))
    assert [g[1] for g in li.Scanner(li.Index({"long": long}), li.COVERAGE)(drift)] == [1.0]
    assert [g[0] for g in li.Scanner(li.Index({"two": "Public Domain"}), li.COVERAGE)("in the public domain now")] == ["two"]


def test_every_match_with_other_words_is_a_candidate():
    rng = random.Random(4)
    for n in [*range(1, 40), 64, 120]:
        template = [f"t{k}" for k in range(n)]
        scan = li.Scanner(li.Index({"t": " ".join(template)}), li.COVERAGE)
        for _ in range(10):
            other = set(rng.sample(range(n), n - int(np.ceil(0.8 * n - 1e-9))))
            text = " ".join("other" if k in other else w for k, w in enumerate(template))
            assert [g[2] for g in scan("ahead " + text + " after")] == [n - len(other)]


def test_neighbouring_licences_are_told_apart():
    scan = li.Scanner(INDEX, li.COVERAGE)
    named = lambda text: [g[0] for g in scan(text)]
    header = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
              "published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    assert named(header.format(2)) == ["GPL-2.0-header"] and named(header.format(3)) == ["GPL-3.0-header"] and named(header.format(9)) == []
    assert named(header.format(3).replace("General", "Affero General")) == ["AGPL-3.0-header"]
    assert named(header.format("2.1").replace("General", "Lesser General").replace("program", "library")) == ["LGPL-2.1-header"]
    assert named("Released under an Example License") == [] and named("Released under the BSD License") == ["BSD"]
    assert named("Licensed under CC BY-NC-SA 4.0") == ["CC-BY-NC-SA-4.0"] and named("Licensed under CC BY-NC-SA 9.0") == []
    assert named("// SPDX-License-Identifier: GPL-2.0-only") == ["SPDX-GPL-2.0-only"]


def test_texts_of_the_distribution():
    """Texts that were published elsewhere, not cut from the templates."""
    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts on this machine")
    scan = li.Scanner(INDEX, li.COVERAGE)
    for file, name in {"BSD": "BSD-3-Clause-text", "GPL-2": "GPL-2.0-header", "GPL-3": "GPL-3.0-title", "LGPL-2.1": "LGPL-2.1-header",
                       "LGPL-3": "LGPL-3.0-title", "Apache-2.0": "Apache-2.0-title", "MPL-2.0": "MPL-2.0-title", "CC0-1.0": "CC0-1.0-title"}.items():
        assert name in [g[0] for g in scan((folder / file).read_text())], file


def test_templates_are_winnowed():
    """All of 16 words or more, and winnowing leaves runs out of the index."""
    long = {n for n, h in INDEX.words.items() if len(h) >= 16}
    assert long and long <= INDEX.thinned == {n for n, h in INDEX.words.items() if li.run_of(len(h), li.COVERAGE) >= li.GRAM + li.WINDOW - 1}
    kept = sum(len(v) for (_, thin), places in INDEX.places.items() if thin for v in places.values())
    assert kept < 0.75 * sum(len(INDEX.words[n]) - li.GRAM + 1 for n in INDEX.thinned)


def test_recall_of_edited_and_interleaved_texts():
    """Words replaced up to the coverage are always found; of texts with a foreign word after every second or third, 0.9."""
    rng, scan = random.Random(6), li.Scanner(INDEX, li.COVERAGE)
    found = {"replaced": [], 2: [], 3: []}
    for name in sorted(INDEX.thinned):
        words = li.TEMPLATES[name].split()
        bare = [k for k, w in enumerate(words) if li.word_hash(w.lower().encode()) >= 0]
        must = {int(x) for w, _ in INDEX.must[name] for x in w}
        free = [k for k in bare if li.word_hash(words[k].lower().encode()) not in must]
        for _ in range(5):
            other = set(rng.sample(free, min(int(0.2 * len(bare)), len(free))))
            text = " ".join(f"other{k}" if k in other else w for k, w in enumerate(words))
            found["replaced"].append(name in [g[0] for g in scan("some words ahead " + text + " and after")])
            for every in (2, 3):
                mixed = " ".join(w + (f" x{rng.random()}" if k % every == every - 1 else "") for k, w in enumerate(words))
                found[every].append(name in [g[0] for g in scan("ahead " + mixed + " after")])
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    assert recall["replaced"] == 1.0 and recall[2] >= 0.9 and recall[3] >= 0.9, recall


def test_the_same_finds_without_winnowing(spark, monkeypatch):
    """Every single word of a template as a candidate: the finds of all documents are the same."""
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    winnowed = li.Scanner(INDEX, li.COVERAGE)
    monkeypatch.setattr(li, "GRAM", 1)
    monkeypatch.setattr(li, "WINDOW", 1)
    monkeypatch.setattr(li, "run_of", lambda words, coverage: 1)
    whole = li.Scanner(li.Index(li.TEMPLATES), li.COVERAGE)
    assert [winnowed(t) for t in texts] == [whole(t) for t in texts]
