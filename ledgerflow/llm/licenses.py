"""License scans: lines and blocks of lines against license templates by the Dice coefficient over word bigrams.

A line is a unit. So is a block: a run of lines most of whose bigrams are in one template, as a license wrapped over several lines
of a source file is. So is a stretch of a line that is no match as a whole: a run of places whose bigrams are in the template, as a
notice inside a longer line is. Sizes prune: with a and b distinct bigrams, Dice is at most 2 * min(a, b) / (a + b).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, stored
from .decontam import tokens

MIN_DICE = 0.8
#: A line belongs to a block where at least this share of its bigrams is in the template; up to MAX_GAP lines may lie between two such
#: lines (blank ones, a line cut within a word).
LINE_SHARE, MAX_GAP = 0.5, 2
#: Up to this number of places without a bigram of the template may lie within a stretch of a line (three altered words make four).
MAX_HOLE = 4
#: Texts with a block or a line to be looked into are split again; up to this number (24 bytes and a name each) they are told
#: by broadcast.
BROADCAST_BLOCKS = 500_000
# License notices and short licenses as their authors publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def places(words: str) -> Column:
    """Hashes of the pairs of neighbouring words in the array column, in order."""
    pairs = F.expr(f"transform(sequence(1, greatest(size({words}) - 1, 1)), i -> xxhash64({words}[i - 1], {words}[i]))")
    return F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<bigint>"))


def bigrams(words: str) -> Column:
    """Hashes of the distinct pairs of neighbouring words in the array column."""
    return F.array_distinct(places(words))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, t_size (distinct bigrams), t_places (all) and bg: one row per template and bigram. As large as the given templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, t_text string")
    rows = rows.select("license", tokens(F.col("t_text")).alias("t_words")).select("license", bigrams("t_words").alias("b"), (F.size("t_words") - 1).alias("t_places"))
    return rows.where(F.size("b") > 0).select("license", F.size("b").alias("t_size"), "t_places", F.explode("b").alias("bg"))


def stretches(units: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, same, u_size and t_size of each stretch of the units (keys, unit: the text): shared places in a row with small holes.

    A stretch of fewer places than the template has is widened to that number, as far as the unit goes, by places that are not shared.
    """
    units = units.withColumn("_w", tokens(F.col("unit"))).drop("unit")
    units = settled(units, F.col("_w").alias("w")).drop("_w").select(*keys, (F.size("w") - 1).alias("n_places"), F.posexplode(places("w")).alias("at", "bg"))
    same = F.broadcast(table).select("bg", F.col("license").alias("of"), "t_size", "t_places")
    hits = units.join(same, "bg").where("of = license").drop("of").distinct()  # distinct: a row may be there several times
    w = Window.partitionBy(*keys).orderBy("at")
    new = (F.col("at") - F.lag("at").over(w) > MAX_HOLE + 1).cast("int")
    runs = hits.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("_new").over(w))
    others = F.greatest(F.max("at") - F.min("at") + 1, F.least("t_places", "n_places")) - F.count("*")
    found = runs.groupBy(*keys, "run", "t_size", "t_places", "n_places").agg(F.count_distinct("bg").alias("same"), others.alias("others"))
    return found.select(*keys, "same", (F.col("same") + F.col("others")).alias("u_size"), "t_size")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), license, dice, line, n_lines, n_matches for every row of docs.

    Units are the lines of a text, its blocks (line: their first one) and, for each license that a line does not match as a whole, its
    stretches (as long as the template at least; a place without a bigram of it counts as a bigram of its own). license is that of the
    largest Dice, then the first in line and name; n_matches counts (unit, license) pairs of min_dice or more. Null and empty texts,
    and texts without a match, have nulls and 0. Repeated rows get equal answers; a null id is an id of its own. An empty table gives an empty result. Only
    the id and text columns are read. Words that a line break cuts in two are two words; a stretch ends with its line.
    """
    spark = docs.sparkSession
    table = stored(template_table(spark, templates or TEMPLATES))  # as large as the given templates
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("x"))
    lines = base.where(F.col("x").isNotNull()).select("doc_id", "th", F.posexplode(F.split("x", "\n")).alias("line", "unit"))
    keys = ["doc_id", "th", "line", "license"]

    def dice(units: DataFrame, *also: str) -> DataFrame:
        """same (distinct bigrams shared with the template), u_size and t_size of each unit and license with any; unit is the text."""
        units = units.withColumn("_w", tokens(F.col("unit"))).drop("unit")
        units = settled(units, F.col("_w").alias("w")).withColumn("_b", bigrams("w")).drop("w", "_w")
        units = settled(units, F.col("_b").alias("b")).drop("_b").withColumn("u_size", F.size("b"))
        found = units.withColumn("bg", F.explode("b")).drop("b").join(F.broadcast(table).select("bg", F.col("license").alias("of"), "t_size"), "bg")
        if "license" in units.columns:
            found = found.where("of = license").drop("of")
        else:
            found = found.withColumnRenamed("of", "license")
        # Rows that are there several times have the same bigrams: each counts once.
        return found.groupBy(*keys, *also, "u_size", "t_size").agg(F.count_distinct("bg").alias("same"))

    value = 2 * F.col("same") / (F.col("u_size") + F.col("t_size"))
    is_match = F.col("u_size").between(low * F.col("t_size"), high * F.col("t_size")) & (value >= min_dice)
    enough = lambda df: df.where(is_match).withColumn("dice", value)
    # Dice of min_dice or more means that at least low * t_size bigrams are shared.
    close, rich = F.col("same") >= LINE_SHARE * F.col("u_size"), F.col("same") >= low * F.col("t_size")
    shared = stored(dice(lines).where(close | rich))
    near = shared.where(close)
    single = enough(near).select(*keys, F.lit(1).alias("n_lines"), "dice")
    # Runs of near lines; a block of two lines or more is looked at where its bigrams, with those across its line breaks, can be enough.
    w = Window.partitionBy("doc_id", "th", "license").orderBy("line")
    new = (F.col("line") - F.lag("line").over(w) > MAX_GAP + 1).cast("int")
    runs = near.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("_new").over(w))
    blocks = runs.groupBy("doc_id", "th", "license", "run", "t_size").agg(F.min("line").alias("line"), (F.max("line") - F.min("line") + 1).alias("n_lines"), F.sum("same").alias("most"))
    blocks = blocks.where((F.col("n_lines") > 1) & (F.col("most") + F.col("n_lines") >= low * F.col("t_size"))).select(*keys, "n_lines")
    # A line to be looked into has no number of lines.
    inside = shared.where(rich & ~is_match)
    wanted = stored(blocks.unionByName(inside.select(*keys, F.lit(None).cast("int").alias("n_lines"))))
    some = F.broadcast(wanted) if wanted.count() <= BROADCAST_BLOCKS else wanted
    some = some.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "license", "line", "n_lines")
    texts = base.join(some, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th"))).withColumn("_l", F.split("x", "\n"))
    texts = settled(texts, F.col("_l").alias("l"))
    texts = stored(texts.select(*keys, "n_lines", F.array_join(F.slice("l", F.col("line") + 1, F.coalesce("n_lines", F.lit(1))), "\n").alias("unit")))
    several = enough(dice(texts.where(F.col("n_lines").isNotNull()), "n_lines")).select(*keys, "n_lines", "dice")
    stretch = enough(stretches(texts.where(F.col("n_lines").isNull()).drop("n_lines"), table, keys)).select(*keys, F.lit(1).alias("n_lines"), "dice")
    found = stored(single.unionByName(several).unionByName(stretch))
    best = found.groupBy("doc_id", "th").agg(F.min(F.struct((-F.col("dice")).alias("d"), "line", "license", "n_lines")).alias("m"), F.count("*").alias("n_matches"))
    best = best.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "m.license", F.round(-F.col("m.d"), 4).alias("dice"), "m.line", "m.n_lines", "n_matches")
    rows = base.select("doc_id", "th").join(best, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    return rows.select("doc_id", "th", "license", "dice", "line", "n_lines", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"))
