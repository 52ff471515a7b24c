"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into sentences twice: at stops and line ends, and at stops and empty lines, so that wrapped sentences are whole. For
the second cut comment marks at either end of a line are taken away, so a line with nothing else is empty, and a line that begins
like a copyright notice stands alone. Sentences
are normalised (lower case, anything but ASCII letters and digits is one blank) and joined with the known licence sentences; the table of
these can be given. The identifiers found, in order, are matched against rules: a rule holds if its identifiers occur in its
order, with others between them or not. `SPDX-License-Identifier:` states each identifier of the SPDX list that stands in the
expression after it, exceptions left out; a plus at its end is read as "or later".

Texts of any length and any number of known sentences are matched in one pass. Of the two cuts of a text, `sentences` shows that with
the longer list, the first if they tie. An empty table gives no rows. Null and empty texts have no sentence. Rows without a known sentence aren't returned. Rows that repeat give a result each. Other
columns than doc_id and text are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oeuvre.llm.spdx import IDENTIFIERS

# Licence sentences by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-named": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "apache-head": "Version 2.0, January 2004",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl2-date": "Version 2, June 1991",
    "gpl3-date": "Version 3, 29 June 2007",
    "lgpl21-date": "Version 2.1, February 1999",
    "agpl3-date": "Version 3, 19 November 2007",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl2-version": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-library": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-head": "Mozilla Public License Version 2.0",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-copy-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd0-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-head": "CC0 1.0 Universal",
    "cc0-software": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "epl1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-http": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "epl2-head": "Eclipse Public License - v 2.0",
    "epl1-head": "Eclipse Public License - v 1.0",
}

# Licences by the sentences that state them, in order.
RULES = [
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-header", "apache-terms", "apache-see"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-named"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-warranty"]),
    ("MIT", ["spdx-mit"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-3.0-only", ["spdx-gpl3"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("Apache-2.0", ["apache-head"]),
    ("GPL-2.0-only", ["gpl-title", "gpl2-date"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-only", ["gpl2-version"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-only", ["gpl-title", "gpl3-date"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    ("LGPL-2.1-only", ["lgpl-title", "lgpl21-date"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-3.0-only", ["lgpl-title", "gpl3-date"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-library"]),
    ("AGPL-3.0-only", ["agpl-title", "agpl3-date"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("MPL-2.0", ["mpl2-head"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy-s"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("0BSD", ["bsd0-grant"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-head"]),
    ("CC0-1.0", ["cc0-software"]),
    ("EPL-1.0", ["epl1"]),
    ("EPL-1.0", ["epl1-head"]),
    ("EPL-2.0", ["epl2"]),
    ("EPL-2.0", ["epl2-http"]),
    ("EPL-2.0", ["epl2-head"]),
]

#: A longer rule that holds makes these shorter ones void.
CONTAINS = {"BSD-3-Clause": ["BSD-2-Clause"]}

LINES = r"[.!?]+[\s]+|[\r\n]+"
STOPS = r"[.!?]+[\s]+|:[ \t]*[\r\n]+|[\r\n][ \t]*[\r\n]+"

#: Comment marks around a line end, and the lines of copyright notices; texts are in lower case.
MARKS = r"(?:\G|(?<![ \t#*/;%!|<>-]))[ \t#*/;%!|<>-]*+(?:\r\n|\r|\n)(?:[ \t#*/;%!|<>-]|(?:dnl|rem)(?=\s))*+"
NOTICE = r"(?:^|(?<=\n))[ \t#*/;%!|<>-]*(copyright[ \t]+(?:\(c\)|©|[0-9]{4})[^\n]*)"

SPDX = "spdx license identifier "
LATER = r"(spdx-license-identifier:[^\r\n]*?[0-9])\+"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def occur(found: Column, ids: list[str]) -> Column:
    """Whether these ids occur in this order in the array `found`; one pass over it, whatever its length."""
    wanted = F.array(*map(F.lit, ids))
    seen = F.aggregate(found, F.lit(0), lambda n, x: n + F.when(x == F.get(wanted, n), 1).otherwise(0))
    return F.array_contains(found, ids[0]) & (seen == len(ids))


def sentences(documents: DataFrame) -> DataFrame:
    """(row, doc_id, cut, place, sentence): the sentences of each row by either cut."""
    text = F.lower(F.coalesce("text", F.lit("")))
    # A second time for a second plus on the line.
    text = F.when(text.contains("spdx-license-identifier:"), F.regexp_replace(F.regexp_replace(text, LATER, "$1-or-later"), LATER, "$1-or-later")).otherwise(text)
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    whole = F.when(F.col("text").contains("\n"), F.split(F.regexp_replace(F.regexp_replace("text", MARKS, "\n"), NOTICE, "\n\n$1\n\n"), STOPS)).otherwise(F.expr("array()"))
    cuts = F.array(F.struct(F.lit(0).alias("cut"), F.split("text", LINES).alias("parts")), F.struct(F.lit(1).alias("cut"), whole.alias("parts")))
    rows = docs.select("row", "doc_id", F.explode(cuts).alias("c")).select("row", "doc_id", "c.cut", F.posexplode("c.parts").alias("place", "part"))
    rows = rows.select("row", "doc_id", "cut", "place", F.trim(F.regexp_replace("part", "[^a-z0-9]+", " ")).alias("sentence"))
    stated = F.split(F.regexp_replace("sentence", f"^{SPDX}", ""), " (?:or(?! later)|and|with) ")
    each = F.when(F.col("sentence").startswith(SPDX), F.transform(stated, lambda x: F.concat(F.lit(SPDX), x))).otherwise(F.array("sentence"))
    return rows.select("row", "doc_id", "cut", "place", F.explode(each).alias("sentence"))


def known_sentences(texts: dict[str, str], identifiers: list[str]) -> list[tuple[str, str, str | None]]:
    """(sentence, id, licence that it states by itself). Identifiers that are among the texts are left to their rules."""
    known = {normal(s): (normal(s), i, None) for i, s in texts.items()}
    for name in sorted(identifiers, key=lambda n: n.endswith("+")):
        plain = normal(SPDX + name.replace("+", "-or-later"))
        known.setdefault(plain, (plain, normal("spdx " + name.replace("+", "-or-later")).replace(" ", "-"), name))
    return list(known.values())


def scan(documents: DataFrame, texts: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, contains: dict[str, list[str]] | None = None, identifiers: list[str] | None = None) -> DataFrame:
    """doc_id, licences (comma-joined, by name), sentences (identifiers in order) of the rows with a known sentence. Tables
    that are not given are `SENTENCES`, `RULES`, `CONTAINS` and the SPDX list."""
    spark = documents.sparkSession
    texts, rules = SENTENCES if texts is None else texts, RULES if rules is None else rules
    contains, identifiers = CONTAINS if contains is None else contains, IDENTIFIERS if identifiers is None else identifiers
    table = known_sentences(texts, identifiers)
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({', '.join(map(quoted, row))})" for row in table)
    known = spark.sql(f"SELECT sentence, id, CAST(stated AS STRING) AS stated FROM VALUES {values} AS known(sentence, id, stated)")
    found = sentences(documents).join(F.broadcast(known), "sentence")
    order = F.sort_array(F.collect_list(F.struct("place", "id")))
    each = found.groupBy("row", "doc_id", "cut").agg(order["id"].alias("ids"), F.collect_set("stated").alias("stated"))
    by_rule = [F.when(occur(F.col("ids"), ids), F.lit(name)) for name, ids in rules]
    named = F.concat(F.array_compact(F.array(*by_rule, F.lit(None).cast("string"))), "stated")
    names = F.flatten(F.collect_list("named"))
    each = each.withColumn("named", named).withColumn("ids", F.array_join("ids", ","))
    rows = each.groupBy("row", "doc_id").agg(names.alias("names"), F.max_by("ids", F.struct(F.length("ids"), -F.col("cut"))).alias("ids"))
    licences = F.array_sort(F.array_distinct("names"))
    for longer, shorter in contains.items():
        licences = F.when(F.array_contains("names", longer), F.array_except(licences, F.array(*map(F.lit, shorter)))).otherwise(licences)
    return rows.select("doc_id", F.array_join(licences, ",").alias("licences"), F.col("ids").alias("sentences"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
