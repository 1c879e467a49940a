"""Licence scans, chat formatting, decontamination and sharding."""

import collections
import hashlib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm import chat, decontamination, licenses, sharding

# --- licence scans ---


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    return {r["doc_id"]: (r["sentence_ids"], r["licenses"], r["n_unmatched"]) for r in licenses.scan_licenses(df).collect()}


def test_full_text_rule_comes_before_its_parts(spark):
    mit = "\n".join(["MIT License", "", *[t for i in ("MIT-GRANT", "MIT-NOTICE", "AS-IS-MIT", "NO-LIABILITY-MIT") for t in licenses.SENTENCES[i][:1]]])
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    got = scan(spark, [mit, wrapped, "// " + mit.replace("\n", "\n// ")])
    for k in got:
        assert got[k][1] == ["MIT"] and got[k][2] == 0, got[k]


BSD = """Copyright (c) 2001, {owner}
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{a} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{b} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
OF SUCH DAMAGE.
"""


@pytest.mark.parametrize("owner", ["the copyright holder", "Acme Inc.", "the University of Nowhere, Dept. 5", "ACME"])
def test_bsd_texts_of_any_owner(spark, owner):
    third = f"\n{{c}} Neither the name of {owner} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    ads = "\n3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by X.\n"
    texts = []
    for marks in (("1.", "2.", "3."), ("*", "*", "*"), ("(a)", "(b)", "(c)")):
        a, b, c = marks
        for more in ("", third.format(c=c), ads + third.format(c="4.")):
            texts.append(BSD.format(owner=owner, a=a, b=b, more=more, who=owner.upper().replace(".", "")))
    got = scan(spark, texts)
    assert [got[i][1] for i in range(len(texts))] == [["BSD-2-Clause"], ["BSD-3-Clause"], ["BSD-4-Clause"]] * 3


def test_ways_to_name_a_licence(spark):
    texts = {
        "This code is licensed under the MIT License.": "MIT",
        "Distributed under the MIT license": "MIT",
        "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
        "Released under the terms of the Apache License, Version 2.0.": "Apache-2.0",
        "The software is made available under the Apache 2.0 licence.": "Apache-2.0",
        "This library is distributed under the GNU Lesser General Public License v2.1.": "LGPL-2.1",
        "Licensed under the GPLv3.": "GPL-3.0",
        "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0",
        "# SPDX-License-Identifier: CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Mozilla Public License Version 2.0": "MPL-2.0",
        "under the MIT umbrella": "",
        "The house is under construction.": "",
    }
    got = scan(spark, list(texts))
    assert {t: " AND ".join(got[i][1]) for i, t in enumerate(texts)} == texts


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "MIT License", 5, "x", "y")] * 2, "doc_id long, text string, n_unmatched int, sentence_ids string, __matched string")
    rows = licenses.scan_licenses(df.drop("__matched")).collect()
    assert [(r["doc_id"], r["licenses"], r["n_unmatched"]) for r in rows] == [(1, ["MIT"], 0)] * 2


def test_notices_after_text_and_several_licences(spark):
    got = scan(spark, ["some words\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "all rights reserved.", "no licence here", "", None])
    assert got[0][1] == ["MIT", "CC-BY-NC-4.0"]
    assert got[1] == (["RESERVED"], [], 1)
    assert got[2] == got[3] == got[4] == ([], [], 0)


def test_every_name_is_recognised_and_long_texts_are_read_whole(spark):
    filler = "lorem ipsum dolor. " * 2_000
    sentences = {**licenses._name_sentences(), **licenses.SENTENCES}
    names = [(rule[0], text) for rule in licenses.RULES if len(rule[1]) == 1 for text in sentences[rule[1][0]]]
    got = scan(spark, [filler + text for _, text in names])
    assert [got[i][1] for i in range(len(names))] == [[n] for n, _ in names]


def test_empty_table(spark):
    assert scan(spark, []) == {}


# --- chat formatting ---


CONTROLLED = st.lists(st.sampled_from([*"ab\\<[|/\n>]", *chat.CONTROL]), max_size=20).map("".join)


def test_escapes_round_trip(spark):
    rng = random.Random(0)
    parts = [*chat.CONTROL, "\\", "<", "[", "a", "\n", "|", "<\\s>", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    assert df.where(chat.unescape(F.col("e")) != F.col("t")).count() == 0
    found = [r["e"] for r in df.select("e").collect()]
    assert not any(c in e for e in found for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(CONTROLLED)
def test_the_pattern_is_its_own_inverse(text):
    escaped = re.sub(chat.PATTERN, r"\1\\\2\3", text)
    assert re.sub(chat.ESCAPED, r"\1\2\3", escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_layouts_become_the_same_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]},
        {"instruction": "hi", "output": "ho"},
        {"instruction": "hi", "input": "", "output": "ho"},
        {"prompt": "hi", "completion": "ho"},
        {"question": "hi", "answer": "ho"},
        {"turns": [{"turn": 0, "role": "user", "text": "hi"}, {"turn": 1, "role": "assistant", "text": "ho"}]},
    ]
    bad = ["not json", None, json.dumps({"unknown": 1}), "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*map(json.dumps, records), *bad])], "id int, record string")
    got = {r["id"]: r for r in chat.format_turns(chat.canonical_turns(df)).collect()}
    for i in range(len(records)):
        assert [tuple(t) for t in got[i]["turns"]] == [("user", "hi"), ("assistant", "ho")]
        assert got[i]["formatted"] == "<|turn|>user\nhi<|end|>\n<|turn|>assistant\nho<|end|>\n"
        (span,) = got[i]["loss_spans"]
        assert got[i]["formatted"][span["start"] : span["start"] + span["length"]] == "ho"
    for i in range(len(records), len(records) + len(bad)):
        assert got[i]["layout"] is None and got[i]["formatted"] == ""
    shapes = [r["fingerprint"] for r in got.values() if r["id"] < 7]
    assert len(set(shapes)) == 7


def test_examples_have_the_fingerprint_of_their_variant(spark):
    examples = [x for layout in chat.LAYOUTS.values() for x in layout.examples]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(examples)], "i int, j string")
    got = {r["i"]: r["f"] for r in df.select("i", chat.fingerprint(F.parse_json("j")).alias("f")).collect()}
    assert [got[i] for i in range(len(examples))] == [chat._digest(x) for x in examples]


def test_structs_of_known_and_unknown_layouts(spark):
    df = spark.createDataFrame([(1, ("q", "a"), "x"), (2, None, "y")], "id int, record struct<question:string,answer:string>, turns string")
    got = {r["id"]: r for r in chat.canonical_turns(df).collect()}
    assert got[1]["layout"] == "question_answer" and [tuple(t) for t in got[1]["turns"]] == [("user", "q"), ("assistant", "a")]
    assert got[2]["layout"] is None and got[2]["turns"] is None
    odd = spark.createDataFrame([(1, ("q",))], "id int, record struct<other:string>")
    assert [(r["layout"], r["turns"]) for r in chat.canonical_turns(odd).collect()] == [(None, None)]


def test_roles_and_long_texts_are_read_back_as_they_are(spark):
    roles = ["human", "gpt", "a\0b", "a\\nb", "\\s\\", "x\n<s>", "[\\INST]"]
    rows = [(i, 0, r, f"text {r}") for i, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    long = spark.range(1).select(F.lit(99).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("abc </s> é\n"), 2_200_000).alias("text"))
    df = df.unionByName(long).withColumn("turns", F.lit("clash")).withColumn("formatted", F.lit("clash"))
    out = chat.format_turns(chat.canonical_turns(chat.records_of_rows(df)))
    back = out.select("conv_id", "layout", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    small = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["back"]], r["loss"]) for r in back.where("conv_id < 99").collect()}
    assert small == {i: ("turns", [(r, f"text {r}")], "") for i, _, r, _ in rows}
    (one,) = back.where("conv_id = 99").select(F.size("back").alias("n"), F.sha2(F.col("back")[0]["text"], 256).alias("h"), F.sha2("loss", 256).alias("l")).collect()
    want = hashlib.sha256(("abc </s> é\n" * 2_200_000).encode()).hexdigest()
    assert (one["n"], one["h"], one["l"]) == (1, want, want)


def test_the_query_equals_its_sql_on_odd_conversations(spark, tmp_path):
    import duckdb

    from timberline.llm.queries import ORACLE, QUERIES

    rows = [(1, 0, "human", "hi <s>"), (1, 1, "gpt", "ho"), (2, 0, "a\nb\\</s>", "x"), (2, 1, "assistant", None), (3, 0, None, ""), (None, 0, "assistant", "[INST]"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['op2_chat_format']})").fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES["op2_chat_format"](spark, str(tmp_path)).select(*columns).collect()) == want


def test_rows_with_nulls_ties_and_odd_roles_are_read_back(spark):
    rows = [(1, 0, "us\ner\\n", "a"), (1, 1, None, None), (1, 1, "assistant", "x</s>"), (1, 1, "assistant", "x</s>"), (None, 0, "user", "n"), (2, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.canonical_turns(chat.records_of_rows(df)))
    got = {r["conv_id"]: ([tuple(t) for t in r["back"]], r["loss"]) for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got[1] == ([("us\ner\\n", "a"), ("", ""), ("assistant", "x</s>"), ("assistant", "x</s>")], "x</s>x</s>")
    assert got[None] == ([("user", "n")], "") and got[2] == ([("assistant", "")], "")
    assert chat.records_of_rows(df.limit(0)).count() == 0


# --- decontamination ---


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]


def shingles(t):
    w = words(t)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def brute(docs, items, least=0.75):
    found = {}
    for d, t in docs:
        s = shingles(t)
        for i, item in items:
            own = shingles(item)
            for at in range(max(len(s) - len(own), 0) + 1 if s and own else 0):
                part = s[at : at + len(own)]
                common = sum((collections.Counter(part) & collections.Counter(own)).values())
                value = common / (len(own) + len(part) - common)
                if value >= least:
                    found[d, i] = max(found.get((d, i), 0), value)
    return found


def test_windows_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(8, 40))) for i in range(12)] + [(90, "a b a b a b a b a b a b"), (91, "two words"), (92, ""), (93, None)]
    docs = []
    for d in range(60):
        passage = words(items[d % 12][1])
        for _ in range(d % 4):
            at = rng.randrange(len(passage))
            passage[at : at + 1] = rng.choice([[], ["zz"], [passage[at], "yy"]])
        docs.append((d, text(rng.choice([0, 3, 50])) + "\n" + " ".join(passage).upper() + "\t" + text(rng.choice([0, 4, 60]))))
    docs += [(100, "a b a b a b a b a b a b x"), (101, "two words"), (102, ""), (103, None), (104, text(500)), (None, items[0][1])]
    df = spark.createDataFrame(docs + [docs[0]], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got.collect()}
    want = brute(docs, items)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_numbers_of_repeats_and_wide_counters(spark):
    rng = random.Random(7)
    arrays = [[rng.randrange(k) for _ in range(n)] for n in (0, 1, 2, 7, 64, 200) for k in (1, 3, 500)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, h array<bigint>")
    got = df.select("i", decontamination.numbered("h").alias("b"), F.expr(decontamination.simhash("h", "size(h)")).alias("s"), F.expr(decontamination.simhash("h", "size(h)").replace("< 65536", "< 0")).alias("wide")).collect()
    bags = {r["i"]: set(r["b"]) for r in got}
    assert all(r["s"] == r["wide"] for r in got)
    for i, a in enumerate(arrays):
        assert len(bags[i]) == len(a)
        for j, b in enumerate(arrays):
            assert len(bags[i] & bags[j]) == sum((collections.Counter(a) & collections.Counter(b)).values())
    (same,) = spark.range(1).select(F.expr(decontamination.simhash("array_repeat(-1L, 70000)", "70000")).alias("s")).collect()
    assert same["s"] == -1


def test_a_very_long_item_and_an_item_held_many_times(spark):
    rng = random.Random(1)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1_500))
    short = " ".join(f"v{i}" for i in range(12))
    docs = [(1, "intro words here " + item + " and an end"), (2, f"{short} filler " * 500), (3, "nothing of it")]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, short), (None, short)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0, r["similarity"], r["start_word"]) for r in got) == [(1, 1, 1.0, 3), (2, 0, 1.0, 0), (2, 2, 1.0, 0)]


def test_no_documents_and_no_items(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.contaminated(docs, items).count() == 1


def test_blocks_guarantee_the_radius():
    assert sum(decontamination._SIZES) == 64 and len(decontamination._SIZES) == decontamination.RADIUS + 1


# --- sharding ---


def table(n, size):
    digests = [hashlib.md5(f"shard-{i}".encode()).hexdigest() for i in range(n)]
    start, stride = [int(h[:15], 16) % size for h in digests], [int(h[16:31], 16) % (size - 1) + 1 for h in digests]
    out, at = [-1] * size, [0] * n
    for turn in range(size):
        s = turn % n
        while out[(start[s] + at[s] * stride[s]) % size] >= 0:
            at[s] += 1
        out[(start[s] + at[s] * stride[s]) % size] = s
    return out


@pytest.mark.parametrize(("n", "size"), [(1, 2), (3, 7), (5, 101), (16, 503)])
def test_table_against_turn_taking(spark, n, size):
    got = {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, n, size).collect()}
    assert [got[i] for i in range(size)] == table(n, size)


def test_few_keys_move_when_a_shard_is_added():
    a, b = table(10, 1009), table(11, 1009)
    assert sum(x != y for x, y in zip(a, b, strict=True)) / 1009 < 0.3


def test_rows_keep_their_columns_and_clashes_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", 9), (1, "s", 9), (None, None, None)], "doc_id long, source string, slot int")
    out = sharding.assign_shards(df, "doc_id", 4, 101)
    assert out.columns == ["doc_id", "source", "slot", "shard"] and out.count() == 3
    assert out.where("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.assign_shards(df.limit(0), "doc_id", 4, 101).count() == 0
    sharding.write_shards(df, "doc_id", str(tmp_path / "out"), 4, 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, 4, 100)


def test_gpl_headers_are_told_apart_by_their_version_clause(spark):
    rest = (
        "\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n\n"
        "You should have received a copy of the GNU General Public License\nalong with this program{} if not, see <https://www.gnu.org/licenses/>.\n"
    )
    terms = "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    versions = {
        "GPL-2.0": "version 2 of the License.",
        "GPL-3.0": "version 3 of the License.",
        "GPL-2.0-or-later": "either version 2 of the License, or\n(at your option) any later version.",
        "GPL-3.0-or-later": "either version 3 of the License, or\n(at your option) any later version.",
    }
    texts = {f"This program is free software{a} {terms}{b} {v}{rest.format(c)}": (name, 0) for name, v in versions.items() for a in ":;" for b in ",;" for c in ".;"}
    texts |= {"This program is free software.": ("", 1), f"This program is free software; {terms}.": ("", 2)}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: (" AND ".join(r["licenses"]), r["n_unmatched"]) for r in licenses.scan_licenses(df).collect()}
    assert got == texts
