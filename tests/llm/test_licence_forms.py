"""Notices that are no copies of the templates, whole licence texts, files without ids, and levels of the tree."""

import duckdb
import pytest

from kwhrecon.llm import common, licences

SF = "/root/testdata/sf0.01"
FORMS = [
    ("# SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
    ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("This project is licensed under the MIT license", "MIT"), ("The project was released under the MIT licence", None),
    (" * it under the terms of the GNU General Public License as published by", "GPL-3.0"), ("BSD 2-Clause License", "BSD-2-Clause"), ("ISC License", "ISC"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free "
     "Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("This file is part of the tool and is licensed under the GNU Affero General Public License version 3", "AGPL-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file,", "MPL-2.0"),
    ("Copyright (c) 2031 Some Body. All rights reserved.", None), ("The licence of the town was not renewed for that year.", None), ("His driver's license was issued by the office.", None),
]


def test_forms(spark):
    files = spark.createDataFrame([(f"f{i}", f"some code\n{text}\nmore code") for i, (text, _) in enumerate(FORMS)], "path string, text string")
    got = {r["path"]: r["licence"] for r in licences.headers(files).collect()}
    assert {f"f{i}": got.get(f"f{i}") for i in range(len(FORMS))} == {f"f{i}": want for i, (_, want) in enumerate(FORMS)}


@pytest.fixture
def tree(spark, tmp_path):
    gnu = licences.GNU.format("General Public License", "2")
    wordy = "\n\n".join(["Each licensee is granted the License under the terms of the GNU General Public License, and may redistribute the program or modify it. "
                          "The Free Software Foundation may publish new versions of the General Public License."] * 150 + [gnu.replace(" ", "\n", 9)])
    prose = "a long tale of other things " * 200 + ". Released under the MIT License. " + "and it goes on and on with more words " * 300
    rows = [(31, wordy, "a"), (26, licences.TEMPLATES[5][1], "a"), (1, "no notice", "a"), (2, "nor here", "a"), (60, "far", "a"), (1060, "further", "a"),
            (62, prose, "b"), (7, "in b", "b"), (None, "no id " + licences.TEMPLATES[5][1], "c"), (None, None, None), (8, "in c", "c"), (8, "in c", "c"), (13 * 80, "middle", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return tmp_path


def test_levels_long_licence_files_and_null_ids(spark, tree):
    got = [tuple(r) for r in licences.query(spark, str(tree)).select("doc_id", "licence", "how", "from_dir").collect()]
    assert len(got) == 13
    by_id = {r[0]: r[1:] for r in got if r[0] is not None}
    assert by_id[31] == ("GPL-2.0", "header", None)  # thousands of words, and it speaks from the top of its source
    assert by_id[1] == by_id[2] == by_id[60] == ("MIT", "directory", "a/0/") and by_id[1060] == by_id[1040] == ("GPL-2.0", "directory", "a/")
    assert by_id[62] == ("MIT", "header", None) and by_id[7] == (None, "none", None)  # a notice in a long text speaks for itself only
    assert (None, "MIT", "header", None) in got and by_id[8] == ("MIT", "directory", "c/")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tree}/documents.parquet/*.parquet')")
    assert sorted(got, key=str) == sorted(con.execute(f"SELECT doc_id, licence, how, from_dir FROM ({licences.SQL})").fetchall(), key=str)


def test_inheritance_over_two_levels_in_the_tables(spark):
    found = licences.query(spark, SF).where("how = 'directory'").collect()
    assert any(r["path"].count("/") - r["from_dir"].count("/") == 2 for r in found)
    assert licences.query(spark, SF).count() == common.read(spark, SF, "documents").count()
