import random
import re

import pytest

from barloom.llm import licenses

from .frames import documents, empty


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(words))
              if words[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_against_brute_force(spark):
    texts = ["MIT License, mit license; the GNU General-Public LICENSE", "apache\nlicense apache license", "mit licenses",
             "mit é license", None, "", "x " * 20000 + "Released under the MIT License.", "KMIT license mit license"]
    docs = documents(spark, texts)
    got = licenses.scan_licenses(docs).collect()
    want = sorted((str(r.doc_id), *map(str, brute(r.text))) for r in docs.collect())
    assert sorted((str(r.doc_id), str(r.n_words), str(r.n_base), str(r.first_word), str(r.last_word), r.base_labels)
                  for r in got) == want
    assert licenses.scan_licenses(empty(docs)).count() == 0


def labels(text):
    return {label for label, _, _ in licenses.scanners()[1].scan(licenses.words_of(text.encode()))}


def test_templates_need_their_mandatory_wording():
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels("provided under the terms of the Apache License Version 2.0") == {"apache-2.0"}
    assert labels("Licensed under the Apache License, Version 2") == set()
    assert labels("Licensed under an Apache License, Version 2.0.") == set()
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3.0"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"}
    assert labels("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License") == {"cc-by-sa-4.0"}
    assert labels("licensed under CC BY 4.0") == {"cc-by-4.0"} and labels("licensed under CC BY ND 3.0") == set()


def wordings(template, optional, pick):
    """A text that a template allows: optional regions kept or left out, and one wording of each replaceable region."""
    text = template
    while "<<beginOptional>>" in text:
        text = re.sub(r"<<beginOptional>>((?:(?!<<beginOptional>>).)*?)<<endOptional>>", r"\1" if optional else " ", text, flags=re.S)

    def wording(tag):
        kinds = re.search(r'match="([^"]*)"', tag[0])[1].split("|")
        kind = kinds[pick % len(kinds)]
        span = re.fullmatch(r"\.\{(\d+),(\d+)\}", kind)
        return "Acme Corporation and its many friends in places".rsplit(" ", 8 - min(int(span[2]), 8))[0] if span else kind

    return re.sub(r"<<var;[^>]*>>", wording, text)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_whole_wordings_only(name):
    pattern = re.compile(" " + licenses._pattern(licenses.TEMPLATES[name]))
    for optional in (True, False):
        for pick in (0, 1):
            text = wordings(licenses.TEMPLATES[name], optional, pick)
            assert name in labels("Copyright 2024 Acme.\n" + text + "\nEnd of file")
            words = [w.decode() for w in licenses.words_of(text.encode())]
            rng = random.Random(len(words))
            for k in sorted(rng.sample(range(len(words)), min(len(words), 25))):
                for changed in (words[:k] + words[k + 1:], words[:k] + ["evil"] + words[k + 1:], words[:k] + ["never"] + words[k:]):
                    text = " ".join(changed)
                    assert (name in labels(text)) == bool(pattern.search(f" {text} "))
    assert name not in labels(" ".join(words[:-1])) and name not in labels(" ".join(words[1:]))


def test_other_conditions_are_refused():
    whole = wordings(licenses.MIT_TEXT, True, 0)
    assert labels(whole) == {"mit-text"}
    opening = whole[:whole.index(", and to permit")]
    assert labels(opening) == set()
    assert labels(opening + " provided that it is used for Good, not Evil and never by competitors") == set()
    assert labels(whole.replace("subject to the following conditions:", "subject to the following conditions: no harm;")) == set()
    three = wordings(licenses.TEMPLATES["bsd-3-clause"], True, 0)
    assert labels(three) == {"bsd-3-clause"}
    assert labels(three.replace("without specific prior written permission", "without payment")) == set()
    assert labels(three.replace("are permitted provided", "are permitted for research provided")) == set()
    gpl = licenses.GNU_HEADER.format(name="GNU General Public License", version="3", later=licenses.GNU_LATER)
    assert labels(wordings(gpl, True, 0)) == {"gpl-3.0-or-later"}


def test_spans_and_score(spark):
    docs = spark.createDataFrame([(1, "note: released under the MIT License."), (2, "the mit license"), (3, "none")],
                                 "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [tuple(s) for s in rows[1].spans] == [("mit-notice", 1, 6)] and rows[1].labels == "mit,mit-notice"
    assert [rows[k].score for k in (1, 2, 3)] == [1.0, 0.5, 0.0]
