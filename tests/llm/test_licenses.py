import random

import numpy as np
from frames import clashing, documents, rows

from pagesift.llm import licenses as L


def brute(matcher, text):
    """The same rule over the whole text, without windows and bands."""
    words = L.words_of(text or "")
    own = {}
    ids = np.array([matcher.vocabulary.get(w) or len(matcher.vocabulary) + 1 + own.setdefault(w, len(own)) for w in words], np.int64)
    found = []
    for part in matcher.parts:
        values = L.shingles(ids, part.size)
        for n, s in part.sets.items():
            found += L.occurrences(np.flatnonzero(np.isin(values, s)), values, len(s), part.words[n], L.CONTAINMENT, n)
    return sorted(found, key=lambda f: (f[1], f[0]))


def test_bands_keep_the_promise():
    for jaccard, rows_ in ((0.2, 1), (0.5, 2), (0.8, 4)):
        bands = L.bands_for(jaccard, rows_)
        assert (1 - jaccard**rows_) ** bands <= L.MISS < (1 - jaccard**rows_) ** (bands - 1)
    # Whatever its length, a template contained to 0.8 reaches that similarity with the window that holds it.
    for words in range(1, 5000):
        size, shingle = L.window_words(words), min(words, L.SHINGLE)
        own = words - shingle + 1
        need = int(np.ceil(L.CONTAINMENT * own - 1e-9))
        assert need / (size - shingle + 1 + own - need) >= L.LEAST_JACCARD - 1e-9
        assert words + size // 8 <= size


def test_edited_notices_in_noise(spark):
    rng = random.Random(6)
    matcher = L.Matcher(list(L.NOTICES.items()))
    noise = [f"w{i}" for i in range(400)] + ["the", "license", "software", "and", "of"]
    texts = []
    for _ in range(300):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choices(noise, k=rng.randint(0, 80))
            words = rng.choice(list(L.NOTICES.values())).split()
            for _ in range(rng.choice([0, 0, 0, 1, 3])):
                words[rng.randrange(len(words))] = rng.choice(noise)
            text += words
        texts.append(" ".join(text))
    wanted = [brute(matcher, t) for t in texts]
    got = [matcher.scan(t) for t in texts]
    assert sum(map(len, wanted)) > 150
    assert got == wanted
    spans = L.license_matches(documents(spark, texts, 0), L.notices(spark)).collect()
    assert sorted((r.doc_id, r.license_id) for r in spans) == sorted((i, matcher.names[f[0]]) for i, w in enumerate(wanted) for f in w)
    for r in spans:
        first = L.words_of(texts[r.doc_id][r.start : r.end])
        assert texts[r.doc_id][r.start - 1 : r.start].strip() == "" and len(first) >= 5


def test_awkward_rows(spark):
    templates = spark.createDataFrame([("a", "one two three"), ("b", None), (None, "x y z"), ("c", ""), ("d", "solo")], "license_id string, text string")
    docs = clashing(documents(spark, [None, "", "One, two. THREE!", "one two", "é solo é", "solo " * 30_000, "one two three one two three"]))
    docs = docs.unionByName(docs.filter("doc_id = 3"))
    got = [r for r in rows(L.license_matches(docs, templates)) if r[0] != 6]
    assert got == [(3, "a", 0, 15, 1.0), (3, "a", 0, 15, 1.0), (5, "d", 2, 6, 1.0), (7, "a", 0, 13, 1.0), (7, "a", 14, 27, 1.0)]
    assert rows(L.license_matches(docs, templates, block_bytes=8)) == rows(L.license_matches(docs, templates))
    assert L.license_matches(docs.limit(0), templates).isEmpty() and L.license_matches(docs, templates.limit(0)).isEmpty()


def test_common_licenses_are_found_with_their_version():
    matcher = L.Matcher(list(L.NOTICES.items()))
    grant = "you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; {} of the License, or any later version."
    cases = {
        grant.format("Lesser General", "either version 2.1"): {"GNU-grant", "LGPL-terms", "GNU-version-2.1-or-later"},
        grant.format("General", "either version 2"): {"GNU-grant", "GPL-terms", "GNU-version-2-or-later"},
        grant.format("Affero General", "either version 3"): {"GNU-grant", "AGPL-terms", "GNU-version-3-or-later"},
        "code is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.": {"MPL-2.0-header"},
        L.NOTICES["ISC-0BSD-permission"]: {"ISC-0BSD-permission"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0-work"},
        "see https://creativecommons.org/licenses/by/4.0/ for it": {"CC-BY-4.0-url"},
        L.NOTICES["Unlicense-notice"]: {"Unlicense-notice"},
        L.NOTICES["EPL-2.0-header"]: {"EPL-2.0-header"},
        "Released under the GNU General Public License, version 2.": {"GPL-2.0-version"},
    }
    for text, names in cases.items():
        assert {matcher.names[f[0]] for f in matcher.scan(text)} == names, text
    assert {matcher.names[f[0]] for f in matcher.scan(L.NOTICES["GPL-3.0"])} == {"GPL-3.0", "GPL-3.0-version"}
