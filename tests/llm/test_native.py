"""Licences, mixing and shards against plain Python; their plans hold no Python."""

import zlib
from collections import Counter, defaultdict

import duckdb

from wirelens.llm import licenses, mixing, sharding


def plain(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    return frame.collect()


def test_licenses(spark, documents, awkward):
    texts = ["x y. Licensed under the Apache License, Version 2.0.\nz", "Released under the MIT License. THIS WORK IS LICENSED under the GNU General Public License, version 3!",
             "licensed under the apache license version 2 0 the license\nhello\nyou may not use this file except in compliance with the license",
             "you may not use this file except in compliance with the license; licensed under the apache license version 2 0 the license"]
    rows = [*awkward, *((40 + i, t) for i, t in enumerate(texts))]
    got = sorted(((r.doc_id, r.n_sentences, ",".join(r.sentence_ids), ",".join(r.licenses)) for r in plain(licenses.scan(documents(rows)))), key=repr)
    named = {r[0]: r[3] for r in got}
    assert [named[40 + i] for i in range(4)] == ["Apache-2.0", "MIT,GPL-3.0-only", "Apache-2.0", ""]
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", [(r[0], r[1]) for r in rows])
    assert got == sorted(duck.execute(licenses.answer()).fetchall(), key=repr)
    assert licenses.scan(documents([])).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
THIRD = """
3. Neither the name of Some Company, Inc nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
GPL2 = """ * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
"""
APACHE = """/*
 * Copyright 2020 Some Body
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [
    (MIT, "MIT"), (BSD.format(""), "BSD-2-Clause"), (BSD.format(THIRD), "BSD-3-Clause"), (GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"),
    (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"), ("This project is released under the MIT License.", "MIT"), ("Intro\n\n# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright", "GPL-3.0-only"), ("This file is not licensed under the MIT License.", ""),
    ("We teach at mit. Permission is hereby granted to nobody.", ""),
]


def test_whole_notices(spark, documents):
    """Wrapped, on one line, with Windows line ends, and inside other text."""
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: f"Some words\nin lines.\n\n{t}\n\nMore words; and more."]
    rows = [(i * 10 + j, form(text)) for i, (text, _) in enumerate(NOTICES) for j, form in enumerate(forms)]
    rows += [(1000 + i, " ".join(text.replace("#", "").split())) for i, (text, _) in enumerate(NOTICES[:7])]
    found = {r.doc_id: (r.n_sentences, ",".join(r.sentence_ids), ",".join(r.licenses)) for r in plain(licenses.scan(documents(rows)))}
    for i, (_, name) in enumerate(NOTICES):
        assert [found[i * 10 + j][2] for j in range(3)] == [name] * 3, i
    assert [found[1000 + i][2] for i in range(5)] == [name for _, name in NOTICES[:5]]
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in duck.execute(licenses.answer()).fetchall()} == found


def targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode())
    names += [None] if None in sizes else []
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    full, share = set(), 0.0
    while True:
        rest = sum(weight[n] for n in names if n not in full)
        if not rest:
            break
        share = (sum(sizes.values()) - sum(3 * sizes[n] for n in full)) / rest
        now = {n for n in names if 3 * sizes[n] <= share * weight[n]}
        if now == full:
            break
        full = now
    return {n: min(3 * sizes[n], share * weight[n]) for n in names}


def test_mixing(spark, documents, awkward):
    rows = [*awkward, *((100 + i, " ".join(["w"] * (i * 37 % 90)), "abcd"[i % 7 % 4]) for i in range(400))]
    docs = documents(rows)
    sizes, longest = Counter(), defaultdict(int)
    for _, text, source in rows:
        n = len((text or "").encode().split())
        sizes[source] += n
        longest[source] = max(longest[source], n)
    wanted = targets(sizes)
    mixed = mixing.mix(docs)
    found = plain(mixed)
    assert len(found) == len(rows)
    assert Counter((r.source_size, round(r.target, 6)) for r in found) == Counter((sizes[s], round(wanted[s], 6)) for _, _, s in rows)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken == r.size * r.copies <= 3 * r.size
        taken[r.source_size] += r.taken
    for source, size in sizes.items():
        assert abs(taken[size] - wanted[source]) <= longest[source] / 2 + 1
    key = lambda r: (repr(r.doc_id), r.row, r.copies)
    assert sorted(map(key, found)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    repeated = mixing.repeat_documents(docs, mixed)
    assert repeated.columns == docs.columns
    assert Counter(r.doc_id for r in repeated.collect()) == Counter({d: n for d, n in ((r.doc_id, sum(x.copies for x in found if x.doc_id == r.doc_id)) for r in found) if n})
    assert mixing.mix(documents([])).count() == 0


def test_shards(spark, documents, awkward):
    rows = [*awkward, *((100 + i, f"text {i % 150} " * (i % 11)) for i in range(500))]
    found = plain(sharding.shard(documents(rows)))
    assert len(found) == len(rows)
    texts = {}
    for doc, text in {(r[0], r[1]) for r in rows if r[0] is not None}:
        texts[doc] = (text or "").encode()
    groups, slots, filled, where = Counter(), defaultdict(list), Counter(), defaultdict(set)
    for _, text, *_ in rows:
        groups[zlib.crc32((text or "").encode()) >> 16] += len((text or "").encode()) + 1
    for r in found:
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values()) and set(slots) <= set(range(16))

    def needed(capacity):
        n, full = 1, 0
        for group in sorted(groups):
            n, full = (n, full + groups[group]) if full + groups[group] <= capacity else (n + 1, groups[group])
        return n

    most = max(filled.values())
    assert needed(most) <= 16 and (most == max(groups.values()) or needed(most - 1) > 16)
    assert sharding.shard(documents([])).count() == 0
