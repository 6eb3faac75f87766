"""Each kind of license line that the documents hold has a template."""

import pytest

from evalweave.llm import licenses

LINES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0-notice",
    "Released under the MIT License.": "MIT-notice",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice",
    "All rights reserved.": "All-rights-reserved-notice",
}


@pytest.mark.parametrize("before", ["", "some other words come first. "])
def test_every_kind_of_line(spark, before):
    rows = [(i, f"{before}{line} more words follow it") for i, line in enumerate(LINES)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in found) == list(enumerate(LINES.values()))
