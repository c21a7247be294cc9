"""Labels of licence lines and texts, with their kin beside them."""

import numpy as np
import pytest

from quadrat.llm import licences

MIT = next(t for k, _, t in licences.TEMPLATES if k == "mit-text")
CASES = {
    "Photos licensed under CC BY 4.0.": "cc-by,cc-by-licence",
    "Photos licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "Photos licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
    "Released under the Apache license.": "apache-2.0",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-notice",
    "It is licensed under the GNU Lesser General Public License v3.": "gpl,lgpl",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "gpl,lgpl",
    "All rights reserved.": "reserved",
    "We met under the license office and released the report.": "",
    "Copyright (c) 2020 A. Nobody " + MIT: "mit-text",
    "Copyright " + MIT.replace("merge", "join").replace("sell", "vend"): "mit-text",
    " ".join(MIT.split()[:40]): "mit-grant",
    "": "",
}


@pytest.mark.parametrize("text", list(CASES), ids=range(len(CASES)))
def test_labels(spark, text):
    df = spark.createDataFrame([(1, text), (2, "other words"), (3, None)], "doc_id long, text string")
    assert licences.scan(df).where("doc_id = 1").first().labels == CASES[text]


def test_a_text_of_telling_words_only():
    """A million places of a rare word make no table of a million blocks."""
    data = np.frombuffer(b"sublicense " * 300_000, np.uint8)
    w = licences.Words(data, np.array([0, len(data)]), licences.NOT_ALNUM, licences.LOWER)
    m = licences.Matcher()
    assert all(not len(m.blocks(t, *m.hits(w), w)[0]) for t in m.templates)
