"""Licence scans: a trained paragraph classifier whose findings templates confirm, in Spark expressions."""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import bind

#: Fixed notices by licence family; the words of each are the template that confirms a finding.
TEMPLATES = {
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "This project is licensed under the terms of the MIT license", "SPDX-License-Identifier: MIT"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License", "Distributed under the Apache 2.0 license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "Licensed under the GPL v2 or later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Available under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Available under CC BY-NC-SA 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("Copyright 2020 Example Corp. All rights reserved.", "All rights reserved.", "Copyright 2020 Example Corp.", "Copyright (c) 2020 Example Corp.", "Unauthorized copying of this file is strictly prohibited, proprietary and confidential"),
    "isc": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the LGPL v3", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only"),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "Licensed under the AGPL v3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
}
#: Paragraphs that speak of licences without being under one.
OTHERS = (
    "He lost his driving license and the police asked for permission to search the car", "The city council granted a license to open a new restaurant", "Copyright law is taught in the second year of the course",
    "The general public was not admitted to the hall", "You may use the free parking under the bridge", "The apache helicopter landed near the village", "A fishing license costs less than a hunting license",
    "The software version was released under pressure", "All rights of the tenant are listed in the contract", "Creative work is common in public schools",
    "The copyright act of 1976 came before the court", "All rooms were reserved and the rights of way were blocked", "Which license should a project choose", "The book has a chapter about the history of free software licenses",
    "Lawyers argue about what the license permits", "The judge gave permission to appeal", "Please ask the office for permission to use the hall", "A license server must run before the program starts",
)
#: What turns a notice into talk about it: words before it, and words after it.
DENIALS = (
    "We never said that this is", "It was not", "This is no longer", "He asked whether the code is", "In this chapter we compare what it means that a work is", "Nobody knows if it was", "They refused to have it",
    "An example of a notice reads:", "She explained what is meant by", "The question is not if it is", "Unlike other projects, ours is not",
)
REMARKS = ("is what the author wanted to avoid", "was only discussed and never chosen", "is explained in the next chapter", "would not be allowed here", "is a phrase that many people misread", "and other licenses are compared in the table")
#: Fixed names by licence family, as notices and package files write them.
NAMES = {
    "mit": ("MIT", "MIT License", "MIT license", "Expat"),
    "apache": ("Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache License", "Apache Software License"),
    "gpl": ("GPL", "GPLv2", "GPLv3", "GPL v2", "GPL version 3", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "GNU GPL", "GNU GPL v3", "GNU General Public License", "GNU General Public License v2", "GNU General Public License version 3"),
    "bsd": ("BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD 2-Clause License", "BSD 3-Clause License", "BSD license", "new BSD license", "simplified BSD license"),
    "cc-by": ("CC BY", "CC BY 4.0", "CC BY 2.0", "CC BY 3.0", "CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0 License", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "cc-by-nc": ("CC BY-NC", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 3.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 License", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"),
    "mpl": ("MPL", "MPL-2.0", "MPL 2.0", "MPL 1.1", "Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License Version 1.1", "Mozilla Public License, v. 2.0"),
    "isc": ("ISC", "ISC License", "ISC license"),
    "lgpl": ("LGPL", "LGPLv3", "LGPLv2.1", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "LGPL-3.0-only", "GNU LGPL", "GNU Lesser General Public License", "GNU Lesser General Public License version 3"),
    "agpl": ("AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "GNU AGPL", "GNU Affero General Public License", "GNU Affero General Public License v3"),
}
#: Fixed headers of files and titles of licence texts.
HEADERS = {
    "mit": ("MIT License Copyright (c) 2020 Example Corp", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    "apache": ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements", "The ASF licenses this file to you under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "software distributed under the Apache License is distributed on an AS IS basis"),
    "gpl": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "You should have received a copy of the GNU General Public License along with this program"),
    "bsd": ("BSD 3-Clause License Copyright (c) 2020 Example Corp", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    "cc-by": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",),
    "cc-by-nc": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",),
    "mpl": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License", "Mozilla Public License Version 2.0"),
    "proprietary": ("Copyright (c) 2019-2021 Example Corp. All rights reserved.", "(c) 2020 Example Corp. All rights reserved.", "This software is proprietary and confidential. Unauthorized copying or distribution is strictly prohibited."),
    "isc": ("ISC License Copyright (c) 2020 Example Corp",),
    "lgpl": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "agpl": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
}
#: How a notice names its licence: in training, and in the paragraphs that calibrate.
FRAMES = (
    "License: {}", "license = {}", "SPDX-License-Identifier: {}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This project is licensed under the {}", "The code is {}; see COPYING",
    "Dual licensed under {} and {}", "Available under the {}", "is free software under the {}", "is covered by the {}", "subject to the terms of the {}", "{} licensed", "{}", "{} license", "Code is {}, docs are under another license",
    "The text is available under {}; additional terms may apply", "is distributed under the terms of the {}, see LICENSE", "Photos by the author, {}", "MODULE_LICENSE {}", "uses the {} license",
)
HELD_FRAMES = ("Licence: {}", "license: {} in package file", "We release this under the {}", "The library is licensed under {} or any later version", "All samples are {} licensed", "made available under the terms of {}", "This module is under the {}")
#: Talk about licences by name, likewise.
MENTIONS = (
    "The {} was written by a lawyer", "Is the {} compatible with the {}?", "A comparison of {} and {} is given in the chapter", "He prefers the {} to the {}", "Many companies avoid code under the {}", "What does the {} allow?", "a talk about the {} and its history",
    "questions about the {} were left open", "never licensed under the {}", "The {} is popular among students", "{} is not what we want", "Researchers from {} published the results", "We installed {} on the new machine", "She studied at {} before", "{} was released in April", "Please {} all mails",
)
HELD_MENTIONS = ("The {} is older than the {}", "Critics of the {} say it is too long", "Should we choose {} or {}?", "a professor at {} wrote the report", "{} runs on many sites")
#: Words that may stand around either.
NEUTRAL = "the of and to in that a an it this is be by for with from at on or as can found file files folder code project work next below above see conditions provided following documentation associated copies author authors available any all other named part all-in under text here notice".split()
FAMILIES = tuple(TEMPLATES)
UNKNOWN = "unknown"
#: Paragraphs without any of these stems are not classified: they count as unknown.
GATE = r"(?i)licen[sc]|\bL?A?GPL|copyright|redistribut|permission|prohibited|\bGPL\b|\bMPL\b|\bCC[\s-]+BY|creative\s+commons|rights\s+reserved"
#: Labelled paragraphs for training and for calibration, passes, and the sizes of the model: n-grams of one and two words.
TRAINED_ON, HELD, EPOCHS, FEATURES = 6000, 1500, 12, 6000
#: Buckets of n-grams, so that a lookup meets few of them.
BUCKETS = 1 << 14
#: Probability that a finding needs, and the share of some notice's words that its paragraph must hold.
LEAST_PROBABILITY, LEAST_COVERED = 0.5, 0.6
#: Words of a paragraph that are compared; longer paragraphs are cut into several that overlap.
PARAGRAPH_WORDS = 200
_WORD = r"[a-z0-9.+-]*[a-z0-9]"
#: Stands for blank lines; texts that hold it get a blank for it, and neither is part of a word.
BLANK = "\u0001"
#: Years, or spans of years, are one and the same word. The holder's name in the templates stands for any name.
_YEAR, ANY_YEAR, HOLDER = r"(?<![a-z0-9.+-])(?:19|20)[0-9]{2}(?:-[0-9]{2,4})?(?![a-z0-9])", "0000", "Example Corp"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, re.sub(_YEAR, ANY_YEAR, text.lower()))


def _ngrams(text: str) -> list[str]:
    w = _words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def labelled_paragraph(rng: random.Random, held: bool = False) -> tuple[str, str]:
    """A made-up paragraph and its family or unknown; ``held`` ones have other frames than those of training."""
    family = rng.choice([*FAMILIES, *[UNKNOWN] * 7])
    made_up = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 8)))
    filler = lambda n: " ".join(rng.choice(NEUTRAL) if rng.random() < 0.5 else made_up() for _ in range(n))
    named = lambda f: rng.choice(NAMES[f])
    any_name = lambda: named(rng.choice(list(NAMES)))
    kind = rng.random()
    if family == UNKNOWN:
        if kind < 0.35:
            body = rng.choice(OTHERS)
        elif kind < 0.65:
            body = rng.choice(HELD_MENTIONS if held else MENTIONS).format(any_name(), any_name())
        elif kind < 0.85:
            notice = rng.choice(TEMPLATES[rng.choice(FAMILIES)]).rstrip(".")
            body = rng.choice([f"{rng.choice(DENIALS)} {notice}", f"{notice} {rng.choice(REMARKS)}", f"{rng.choice(DENIALS)} {notice} {rng.choice(REMARKS)}"])
        else:
            words = [w for t in OTHERS for w in t.split()]
            body = " ".join(rng.choice(words) for _ in range(12)) + rng.choice(["", " license", " copyright", " permission"])
    elif family in NAMES and kind < 0.55:
        body = rng.choice(HELD_FRAMES if held else FRAMES).format(named(family), any_name())
    else:
        body = rng.choice(HEADERS[family] if kind < 0.75 else TEMPLATES[family])
        if family != "proprietary" and rng.random() < 0.2:  # whoever holds the rights has licensed the work
            body = rng.choice(TEMPLATES["proprietary"][:4]) + " " + body
    body = body.replace(HOLDER, " ".join(made_up() for _ in range(rng.randint(1, 3))).title())
    return filler(rng.choice([0, 0, 2, 6])) + " " + body + " " + filler(rng.choice([0, 0, 3, 10])), family


@lru_cache(maxsize=1)
def trained_model(seed: int = 3) -> tuple[dict[str, list[float]], list[float]]:
    """Sparse weights by n-gram, and the bias, over FAMILIES and unknown: softmax regression in small steps, then a temperature
    fitted on paragraphs of other frames so that the probabilities, unknown's among them, are calibrated."""
    rng = random.Random(seed)
    rows = [labelled_paragraph(rng) for _ in range(TRAINED_ON)] + [labelled_paragraph(rng, held=True) for _ in range(HELD)]
    grams, counts = [_ngrams(t) for t, _ in rows], {}
    for own in grams[:TRAINED_ON]:
        for g in set(own):
            counts[g] = counts.get(g, 0) + 1
    names = sorted((g for g, n in counts.items() if n >= 3), key=lambda g: (-counts[g], g))[:FEATURES]
    index, classes = {g: i for i, g in enumerate(names)}, (*FAMILIES, UNKNOWN)
    known = [[index[g] for g in own if g in index] for own in grams]
    y = np.array([classes.index(family) for _, family in rows])

    def matrix(some: np.ndarray) -> np.ndarray:
        at = [i * len(names) + g for i, r in enumerate(some) for g in known[r]]
        return np.bincount(np.array(at, np.int64), minlength=len(some) * len(names)).reshape(len(some), len(names)).astype(float)

    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    b[-1] = 1.0
    softmax = lambda z: (e := np.exp(z - z.max(1, keepdims=True))) / e.sum(1, keepdims=True)
    order, gw, gb = np.random.default_rng(seed), np.full_like(w, 1e-3), np.full_like(b, 1e-3)
    for _ in range(EPOCHS):
        for some in np.array_split(order.permutation(TRAINED_ON), TRAINED_ON // 100):
            x = matrix(some)
            error = softmax(x @ w + b)
            error[np.arange(len(some)), y[some]] -= 1
            dw, db = x.T @ error / len(some) + 1e-5 * w, error.sum(0) / len(some)
            gw += dw * dw
            gb += db * db
            w -= 0.3 * dw / np.sqrt(gw)
            b -= 0.3 * db / np.sqrt(gb)
    held = np.arange(TRAINED_ON, len(rows))
    z = matrix(held) @ w + b
    loss = lambda s: -np.log(softmax(s * z)[np.arange(len(held)), y[held]] + 1e-12).sum()
    scale = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    return {g: [round(float(v), 4) for v in scale * w[i]] for g, i in index.items()}, [round(float(v), 4) for v in scale * b]


def _notices() -> list[tuple[str, list[str], list[str]]]:
    """Family and words of each notice or name by which it is known, never a holder, and a year only where little else is left; and
    those of its words that no other family has, of which one must be there."""
    out = []
    for family, notices in TEMPLATES.items():
        for notice in (*notices, *HEADERS[family], *NAMES.get(family, ())):
            words = set(_words(notice.replace(HOLDER, ""))) - {"c"}
            words = words - {ANY_YEAR} if len(words) > 2 else words
            if words and (family, words) not in out:
                out.append((family, words))
    others = {f: set().union(*(w for g, w in out if g != f)) for f in FAMILIES}
    return [(f, sorted(w), sorted(w - others[f])) for f, w in out]


def buckets_of(weights: dict[str, list[float]]) -> list[list[tuple[str, list[float]]]]:
    """The n-grams by checksum; a bucket of a few is all that a lookup reads."""
    out: list[list] = [[] for _ in range(BUCKETS)]
    for g, w in weights.items():
        out[zlib.crc32(g.encode()) % BUCKETS].append((g, w))
    return out


def find(df: DataFrame, text: str) -> DataFrame:
    """df with the columns licences (array of struct line, family, probability) and license_families (comma-joined, sorted).

    Lines of a whole text with a stem of GATE are classified, each alone and, for notices that are wrapped,
    between as many words of the lines around it, up to a blank line, as the longest notice has. More than
    PARAGRAPH_WORDS words are cut into pieces that overlap by twice the longest notice; each stem is judged in
    the piece that holds as many words before and after it. A finding stays if its
    probability is high enough and its words cover one of the family's notices. A line has one finding a
    family, the likeliest; a paragraph of lines has a wrapped one only of a family that none of its lines
    has alone, at the first line that shows it. The model (at most FEATURES n-grams) is fitted in the driver on made-up labelled
    paragraphs and sent as one row. Null and empty texts have no findings. Rows are scanned one by
    one, so ties, repeats and nulls elsewhere change nothing; columns of df with these names are replaced.
    """
    weights, bias = trained_model()
    classes = (*FAMILIES, UNKNOWN)
    model = df.sparkSession.createDataFrame([(buckets_of(weights), bias, _notices())], "__w array<array<struct<gram:string,weights:array<double>>>>, __b array<double>, __n array<struct<family:string,words:array<string>,own:array<string>>>")
    seam = max(len(_words(t)) for ts in TEMPLATES.values() for t in ts)
    part_type = "array<struct<line:int,block:int,joined:boolean,words:array<string>>>"
    words_of = lambda t: F.regexp_extract_all(F.regexp_replace(F.lower(t), _YEAR, ANY_YEAR), F.lit(f"({_WORD})"), F.lit(1))
    body = F.translate(F.coalesce(F.col(text), F.lit("")), BLANK, " ")
    parts = F.split(F.regexp_replace(body, r"(?md)^[^\S\n]*$", BLANK), BLANK)  # a blank line ends one part and begins the next
    of_part = lambda p, k: F.transform(bind(F.split(p, "\n"), lambda ls: F.when(k > 0, F.slice(ls, 2, F.size(ls))).otherwise(ls)), lambda x: F.struct(x.alias("body"), k.alias("block")))
    numbered = F.flatten(F.transform(parts, of_part))

    def opened(line: Column, i: Column) -> Column:
        """Whether a stem begins in the line, and may end in the next."""
        after = F.coalesce(F.get("__lines", i + 1), F.lit(""))
        return line.rlike(GATE) | (F.concat_ws("\n", line, after).rlike(GATE) & ~after.rlike(GATE))

    def around(i: Column) -> Column:
        """Words of the line with those of its neighbours, up to a blank line."""
        before = F.concat(F.array_join(F.slice("__lines", F.greatest(i - seam + 1, F.lit(1)), F.least(i, F.lit(seam))), "\n"), F.lit("\n"))
        after = F.concat(F.lit("\n"), F.array_join(F.slice("__lines", i + 2, seam), "\n"))
        head = bind(words_of(F.element_at(F.split(before, r"\n\s*\n"), -1)), lambda w: F.slice(w, F.greatest(F.size(w) - seam + 1, F.lit(1)), seam))
        return F.concat(head, words_of(F.get("__lines", i)), F.slice(words_of(F.element_at(F.split(after, r"\n\s*\n"), 1)), 1, seam))

    def pieces(line: Column) -> Column:
        i, step = line["line"], PARAGRAPH_WORDS - 2 * seam
        blanks = line["block"]

        def cut(words: Column, joined: bool) -> Column:
            last = F.greatest(F.ceil((F.size(words) - PARAGRAPH_WORDS) / step), F.lit(0)).cast("int")
            piece = lambda k: F.struct(i.alias("line"), blanks.alias("block"), F.lit(joined).alias("joined"), F.slice(words, k * step + 1, PARAGRAPH_WORDS).alias("words"))
            first, end = lambda k: F.when(k > 0, k * step + seam).otherwise(0), lambda k: F.when(k < last, (k + 1) * step + seam).otherwise(F.size(words))
            stem = lambda k: (last == 0) | F.array_join(F.slice(words, first(k) + 1, end(k) - first(k) + 1), " ").rlike(GATE)
            return F.when(F.size(words) > 0, F.transform(F.filter(F.sequence(F.lit(0), last), stem), piece)).otherwise(F.array().cast(part_type))

        return F.concat(bind(words_of(line["body"]), lambda w: cut(w, False)), bind(around(i), lambda w: cut(w, True)))

    def classified(part: Column) -> Column:
        words = part["words"]
        grams = F.concat(words, F.filter(F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1))), lambda g: g.contains(" ")))
        bucket = lambda g: F.get(F.col("__w"), (F.crc32(g.cast("binary")) % BUCKETS).cast("int"))
        known = F.filter(F.transform(grams, lambda g: F.get(F.filter(bucket(g), lambda e: e["gram"] == g), F.lit(0))["weights"]), lambda v: v.isNotNull())
        scores = F.aggregate(known, F.col("__b"), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))

        def verdict(s: Column) -> Column:
            top = F.array_max(s)
            total = F.aggregate(s, F.lit(0.0), lambda t, v: t + F.exp(v - top))
            family = F.element_at(F.array(*map(F.lit, classes)), F.array_position(s, top).cast("int"))
            covers = lambda n: (n["family"] == family) & ((F.size(n["own"]) == 0) | F.arrays_overlap(n["own"], words)) & (F.size(F.array_intersect(n["words"], words)) >= LEAST_COVERED * F.size(n["words"]))
            return F.struct(part["line"].alias("line"), part["block"].alias("block"), part["joined"].alias("joined"), family.alias("family"), (1 / total).alias("probability"), ((family != UNKNOWN) & (1 / total >= LEAST_PROBABILITY) & F.exists(F.col("__n"), covers)).alias("confirmed"))

        return bind(scores, verdict)

    found = F.transform(F.flatten(F.transform(F.col("__gated"), pieces)), classified)
    kept = F.filter(found, lambda x: x["confirmed"])

    def distinct(all_: Column) -> Column:
        """Findings side by side with what may stand for them: of a line alone the likeliest of its family, of a block's wrapped ones none if a line
        alone has the family, else that of the first line, likeliest first. One sort and one look at the neighbour before."""
        rank = F.transform(all_, lambda x, i: F.struct(x["family"].alias("family"), x["block"].alias("block"), x["joined"].alias("joined"), x["line"].alias("line"), (-x["probability"]).alias("loss"), i.alias("place")))

        def first(x: Column, before: Column) -> Column:
            same_block = (before["family"] == x["family"]) & (before["block"] == x["block"])
            same = F.when(x["joined"], same_block).otherwise(same_block & (before["line"] == x["line"]))
            return ~F.coalesce(same, F.lit(False))

        return bind(F.array_sort(rank), lambda s: F.filter(s, lambda x, i: first(x, F.get(s, i - 1))))

    out = df.drop("licences", "license_families")
    own = out.columns
    out = out.withColumn("__numbered", numbered).withColumn("__lines", F.transform("__numbered", lambda x: x["body"]))  # an array of its own, not taken from the other at each use
    opens = lambda x, i: F.struct(i.alias("line"), x["body"].alias("body"), x["block"].alias("block"), opened(x["body"], i).alias("open"))
    out = out.withColumn("__gated", F.filter(F.transform("__numbered", opens), lambda x: x["open"]))
    out = out.crossJoin(F.broadcast(model))  # one row
    found = F.when(F.size("__gated") > 0, bind(kept, distinct)).otherwise(F.array().cast("array<struct<family:string,block:int,joined:boolean,line:int,loss:double,place:int>>"))
    out = out.withColumn("licences", F.array_sort(F.transform(found, lambda x: F.struct(x["line"].alias("line"), x["family"].alias("family"), F.round(-x["loss"], 6).alias("probability")))))
    return out.select(*(F.col(f"`{c}`") for c in own), "licences", F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("license_families"))
