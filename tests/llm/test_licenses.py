"""Long licence texts, their headers in comments, and notices in other wordings than those of the test tables."""

import os

import pytest

from grainmill.llm.license_texts import KNOWN
from grainmill.llm.licenses import license_scan

APACHE = """#!/usr/bin/env python
#
# Copyright 2020 Somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
print(1)
"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 */"""


def test_headers_notices_and_texts_inside_others(docs):
    mit = dict(reversed(KNOWN))["MIT"].replace(". THE", ".\n\nTHE")
    lines = {
        10: ("This project is licensed under the MPL 2.0", "MPL-2.0"), 11: ("// SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), 12: ("Released under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        13: ("This software is distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), 14: ("Licensed under the GNU Affero General Public License v3.0", "AGPL-3.0-only"),
        15: ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"), 16: ("Licensed under the Unlicense", "Unlicense"),
    }
    table = [(1, APACHE), (2, GPL), (3, f"About this code\n\n{mit}\n\nThe end"), (4, "Licensed under GPLv3+"), *((i, f"Some text\n{t}\nmore text") for i, (t, _) in lines.items())]
    found = {r.doc_id: r.notice_ids for r in license_scan(docs(table)).collect()}
    assert found == {1: ["Apache-2.0"], 2: ["GPL-3.0-or-later"], 3: ["MIT"], 4: [], **{i: [want] for i, (_, want) in lines.items()}}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_long_texts(docs):
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [open(f"/usr/share/common-licenses/{n}", encoding="utf-8").read() for n in names]
    found = {r.doc_id: r.license_id for r in license_scan(docs(list(enumerate(texts)))).collect()}
    assert found == dict(enumerate(names.values()))
