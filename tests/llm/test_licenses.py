import itertools
import random
import time

import pytest

from kinweave.llm import licenses as op
from kinweave.llm.text import plain_words

INDEX = op.TemplateIndex(op.TEMPLATES)


def found(text):
    return [(name, text[a:b]) for name, _, _, a, b in op.scan_text(text, INDEX)]


def test_notices_are_found_with_their_spans():
    text = "É word. Licensed under the Apache License, Version 2.0. Other. Released under the MIT License."
    assert found(text) == [
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
        ("MIT", "Released under the MIT License"),
    ]
    assert found("The license was released. MIT is a school under the river.") == []
    assert found("") == [] and op.scan_text(None, INDEX) == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
    return row[-1]


def test_alignment_equals_common_subsequence_inside_the_band():
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 9))]
        b = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 9))]
        matched, first, end = op.align(a, b, 0, 0)
        assert matched == lcs(a, b)
        if matched:
            assert lcs(a, b[first:end]) == matched


@pytest.mark.parametrize("name", list(op.TEMPLATES))
def test_edited_copies_are_found(name):
    rng = random.Random(name)
    words = op.TEMPLATES[name].split()
    for _ in range(20):
        copy = list(words)
        if len(copy) > 10:
            # A copy keeps the words that tell its license from others.
            own = INDEX.own.get(name, ())
            single = [i for i, w in enumerate(copy) if len(p := plain_words(w)) == 1 and p[0] not in own]
            for at in rng.sample(single, len(copy) // 12):
                copy[at] = rng.choice(["other", ""])
        text = "lead in " * rng.randrange(5) + " ".join(copy) + " and on" * rng.randrange(5)
        assert name in {m[0] for m in op.scan_text(text, INDEX)}


@pytest.mark.parametrize("name", op._TEXTS)
def test_whole_texts_and_not_their_openings(name):
    text = op.TEMPLATES[f"{name} text"]
    got = {m[0]: m[2] for m in op.scan_text(f"lead in {text} and on", INDEX)}
    assert got[f"{name} text"] == 1.0
    half = " ".join(text.split()[: len(text.split()) // 2])
    assert f"{name} text" not in {m[0] for m in op.scan_text(half, INDEX)}


@pytest.mark.parametrize("license", list(op._NAMES))
@pytest.mark.parametrize("verb", ["Licensed", "Released"])
def test_notices_name_their_license_alone(license, verb):
    got = op.scan_text(f"Words before. {verb} under {op._NAMES[license]}. Words behind.", INDEX)
    assert [(m[0].split(" ")[0], m[2]) for m in got] == [(license, 1.0)]


SHORT = [n for n, w in INDEX.words.items() if len(w) < 20]


@pytest.mark.parametrize("name", SHORT)
def test_short_notices_at_the_threshold_are_found(name):
    template = INDEX.words[name]
    index = op.TemplateIndex({name: op.TEMPLATES[name]})
    for lost in itertools.combinations(range(len(template)), len(template) // 5):
        for put in ([], [b"an"], [b"quite", b"another"]):
            copy = [b"lead", b"in"]
            for i, w in enumerate(template):
                copy += put if i in lost else [w]
            best = lcs(template, copy)
            assert best >= op.MIN_COVERAGE * len(template)
            text = b" ".join([*copy, b"and", b"on"]).decode()
            assert (name, best) in {m[:2] for m in op.scan_text(text, index)}


@pytest.mark.parametrize("name", [n for n in op.TEMPLATES if n not in SHORT])
def test_copies_torn_by_long_insertions_are_found(name):
    template = INDEX.words[name]
    rng = random.Random(name)
    for size in (9, 20, len(template)):
        at = len(template) // 2 + rng.randrange(-2, 3)
        copy = [*template[:at], *[b"x%d" % i for i in range(size)], *template[at:]]
        text = b" ".join([b"lead", *copy, b"end"]).decode()
        got = [(m[1], m[2], text[m[3] : m[4]]) for m in op.scan_text(text, INDEX) if m[0] == name]
        assert got == [(len(template), 1.0, text[5:-4])]


def test_alignment_without_a_band_equals_common_subsequence():
    rng = random.Random(9)
    for _ in range(500):
        a = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 12))]
        b = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(0, 25))]
        index = op.TemplateIndex({"t": b" ".join(a).decode()})
        matched, first, end = op.align_anywhere(index, "t", b)
        assert matched == lcs(a, b) == lcs(a, b[first:end])


def test_every_repetition_counts():
    text = "x y z. Released under the MIT License. " * 500
    assert len(op.scan_text(text, INDEX)) == 500
    assert len(plain_words(text)) == 4000


def test_rows(spark):
    notice = op.TEMPLATES["MIT"]
    data = [(1, notice, 5), (1, notice, 5), (2, None, 5), (None, "a " + notice, 5), (3, "", 5)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, start int")
    rows = op.scan_licenses(docs).collect()
    assert sorted((str(r.doc_id), r.template, r.coverage, r.start, r.end) for r in rows) == [
        ("1", "MIT", 1.0, 0, 30), ("1", "MIT", 1.0, 0, 30), ("None", "MIT", 1.0, 2, 32)
    ]
    assert op.scan_licenses(docs.limit(0)).count() == 0


def test_planted_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.template) for r in op.scan_licenses(docs).collect()}
    want = {
        (r.doc_id, name)
        for r in docs.collect()
        for name, t in op.TEMPLATES.items()
        if t in r.text
    }
    assert want and want <= got and len(got) <= len(want) * 1.1 + 1


# Names that no template has, some of them of versions or relatives of those that one has.
FOREIGN = [
    "the Eclipse License", "the Eclipse Public License, Version 2.0", "the Zlib License", "the X License",
    "the GNU General Public License, version 1", "the GNU Lesser General Public License, version 4",
    "the Apache License, Version 1.1", "the Apache License, Version 3.0", "the Mozilla Public License, Version 1.1",
    "the BSD 4-Clause License", "the BSD 7-Clause License", "the Common Public License, Version 1.0",
    "CC BY 3.0", "CC BY-SA 2.5", "CC XY 4.0", "CC0 2.0", "MIT 1.0", "the GNU Free Documentation License, version 3",
]


@pytest.mark.parametrize("license", FOREIGN)
@pytest.mark.parametrize("frame", ["Licensed under {}.", "Released under {}.", "This work is licensed under {}."])
def test_foreign_names_are_no_known_license(license, frame):
    for text in (frame.format(license), "See above. " + frame.format(license) + " All of it."):
        got = op.scan_text(text, INDEX)
        # The three-word BSD notice is there, whatever stands between its words.
        names = {m[0].split(" ")[0] for m in got} - ({"BSD"} if "BSD" in license else set())
        assert names <= {op.UNKNOWN}
        if license.endswith("License") and "BSD" not in license or ", " in license:
            assert names == {op.UNKNOWN}


def test_no_license_without_its_own_words():
    """Every notice of a license, under the name of every other one."""
    for license, words in op._NAMES.items():
        for verb in ("Licensed", "Released", "This work is licensed"):
            got = {m[0].split(" ")[0] for m in op.scan_text(f"{verb} under {words}.", INDEX)}
            assert got == {license}


@pytest.mark.parametrize("name", ["GPL-2.0 header", "GPL-3.0 header", "AGPL-3.0 header", "LGPL-2.1 header"])
def test_headers_of_one_frame(name):
    got = {m[0] for m in op.scan_text(f"x {op.TEMPLATES[name]} y", INDEX)}
    assert name in got and not got & {"GPL-2.0 header", "GPL-3.0 header", "AGPL-3.0 header", "LGPL-2.1 header"} - {name}
    old = op.TEMPLATES["GPL-2.0 header"].replace("version 2", "version 1")
    assert {m[0] for m in op.scan_text(old, INDEX)} == {"GPL header"}


MIT = op.TEMPLATES["MIT text"]


@pytest.mark.parametrize("piece, copies", [
    (MIT, 50), (MIT.replace("warranty", "pledge").replace("limitation", "bound"), 50),
    ("licensed under the license ", 4000), ("licensed under the mit bsd isc license version 2 ", 400),
    ("word " * 60 + op.TEMPLATES["MIT"] + " ", 300),
])
def test_time_is_linear_in_the_text(piece, copies):
    def seconds(n):
        text = " ".join([piece] * n)
        begin = time.process_time()
        found = op.scan_text(text, INDEX)
        return time.process_time() - begin, len(found)

    seconds(3)
    (short, few), (long, many) = seconds(copies), seconds(8 * copies)
    assert many >= 7 * few > 0 and long < 16 * short + 0.3


def test_a_very_long_text_of_frame_words():
    begin = time.process_time()
    found = op.scan_text("licensed under the license " * 50_000, INDEX)
    assert {m[0] for m in found} <= {op.UNKNOWN} and time.process_time() - begin < 20
