from pathlib import Path

import pytest

from tracklane.llm import licenses
from tracklane.llm.license_texts import MIT, TEXTS


def test_variants_of_a_text_share_a_digest(make_docs, edges):
    variant = "Copyright (c) 2019 A. Body\nAll rights reserved.\n\n" + MIT.replace("sublicense", "sub-licence").replace(" ", "\n", 40).upper()
    rows = [(1000 + k, t) for k, (_, t) in enumerate(TEXTS)]
    rows += [(50, variant), (51, MIT + " And more."), (52, "x\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0"), *edges]
    out = {r.doc_id: r for r in licenses.scan(make_docs(rows)).collect()}
    assert [out[1000 + k].license for k in range(len(TEXTS))] == [spdx for spdx, _ in TEXTS]
    assert out[50].license == "MIT" and out[51].license is None
    assert out[52].n_notices == 2 and out[52].notices == "CC-BY-NC-4.0,MIT"
    assert all(out[e[0]].license is None and out[e[0]].n_notices == 0 for e in edges)
    assert licenses.scan(make_docs(rows)).count() == len(rows)
    assert licenses.scan(make_docs([])).count() == 0


def test_spark_and_python_agree(spark):
    texts = ["(c) 2020 X\nbody", "Copyright holders are liable", "A & B  http://www.x.org/y", "© by me\n\nOrganisation — Ünïcode"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(licenses.canonical(df.text)).collect()] == [licenses.canonical_text(t) for t in texts]


def test_whole_licences_are_known(make_docs):
    folder = Path("/usr/share/common-licenses")
    if not (folder / "Apache-2.0").exists():
        pytest.skip("no licence texts here")
    named = {"Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "CC0-1.0": "CC0-1.0"}
    texts = [" ".join((folder / f).read_text().split(" ")).replace("\n\n", "\n \n") for f in named]
    out = {r.doc_id: r.license for r in licenses.scan(make_docs(list(enumerate(texts)))).collect()}
    assert [out[k] for k in range(len(named))] == list(named.values())


def test_lines_that_do_not_name_a_licence(make_docs):
    """Whole short licences on one line of a longer document."""
    texts = {spdx: " ".join(t.split()) for spdx, t in TEXTS if spdx in ("ISC", "0BSD", "Zlib", "BSD-2-Clause")}
    assert len(texts) == 4
    rows = [(i, f"some code\n{t}\nmore of it") for i, t in enumerate(texts.values())] + [(9, "\n\n" + "x" * 100_000)]
    out = {r.doc_id: (r.license, r.notices, r.n_notices) for r in licenses.scan(make_docs(rows)).collect()}
    assert out == {i: (None, spdx, 1) for i, spdx in enumerate(texts)} | {9: (None, "", 0)}
