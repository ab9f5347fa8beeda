"""License scans: MinHash bands over overlapping windows, then exact containment; DataFrame functions only.

Words are runs of a-z and 0-9 of the lower-cased text, shingles are three words
(short notices have five).  The shingle hashes of a text are cut into windows of
``2 * STRIDE`` that overlap by half; each window has ``BANDS`` MinHash values, one
to a band (the minimum of ``hash XOR constant``).  Templates are cut the same way,
at every half stride.  A window retrieves a template when a band agrees.

*Band settings.*  A notice of m shingles lies whole inside some window of 16 if
m <= 9; with 3/4 of it there, the similarity is at least 3 / 16 for m = 3, and one of
32 bands agrees with probability 1 - (13/16)^32 > 0.998; longer templates have
windows that agree in more than a third, and 1 - (2/3)^32 > 0.999998 each.

*Verification* counts the template's own shingles in the text: at least
``min_percent`` of them must be there.

A text stays in its row and nothing is shuffled; the template tables are literals
of bounded size (templates x windows x bands).

Cases: null texts and texts of under three words match nothing; other columns
are not read; repeated rows give repeated results; no templates or an empty table
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIDE = 8
BANDS = 32
SHINGLE = 3

# The notices that are looked for.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingle_hashes(w: Column) -> Column:
    n = F.size(w)
    return F.when(n < SHINGLE, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
    )


def _constants() -> list[int]:
    """One constant for each band: multiples of a fixed odd 64-bit number, as signed integers."""
    found = [(i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(BANDS)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in found]


def _minima(hashes: Column) -> Column:
    """The MinHash values of a run of shingles, by band."""
    return F.transform(F.array(*map(F.lit, _constants())), lambda c: F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(c))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", min_percent: int = 75) -> DataFrame:
    """``id_col, license, n_found, n_shingles`` of each notice found in each text."""
    spark = docs.sparkSession
    known = spark.createDataFrame(list(templates.items()), "license string, text string").withColumn("w", words(F.col("text"))).withColumn("h", shingle_hashes(F.col("w")))
    offsets = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("h") - STRIDE), F.lit(STRIDE // 2))
    known = known.select("license", F.array_distinct("h").alias("h"), F.flatten(F.transform(offsets, lambda i: _minima(F.slice("h", i, 2 * STRIDE)))).alias("bands"))
    rows = [r for r in sorted(known.collect()) if r["h"]]
    longs = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<bigint>")
    everything = sorted({x for r in rows for x in r["bands"]})

    step = docs.select(F.col(id_col), words(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    step = step.select(id_col, F.size("_w").alias("_n"), shingle_hashes(F.col("_w")).alias("_h"))
    blocks = F.transform(
        F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_h") - 1) / STRIDE).cast("int"))), lambda i: F.slice("_h", i * STRIDE + 1, STRIDE)),
        _minima,
    )
    step = step.select(id_col, "_h", blocks.alias("_blocks"))
    b = F.col("_blocks")
    windows = F.transform(b, lambda x, i: F.when(i + 1 < F.size(b), F.zip_with(x, F.get(b, i + 1), lambda p, q: F.least(p, q))).otherwise(x))
    step = step.select(id_col, "_h", F.flatten(F.filter(windows, lambda x: F.exists(x, lambda v: v.isin(everything)))).alias("_hit"))
    # no filter before the rows of the generator: it would be moved down and repeat the work above for every shingle
    checks = [
        F.struct(
            F.lit(r["license"]).alias("license"),
            F.when(F.arrays_overlap("_hit", longs(sorted(set(r["bands"])))), F.size(F.array_intersect(longs(r["h"]), F.col("_h")))).otherwise(0).cast("long").alias("n_found"),
            F.lit(len(r["h"])).cast("long").alias("n_shingles"),
        )
        for r in rows
    ]
    empty = F.array().cast("array<struct<license:string,n_found:bigint,n_shingles:bigint>>")
    found = step.select(id_col, F.explode(F.array(*checks) if checks else empty).alias("_m")).select(id_col, "_m.*")
    return found.where(F.col("n_found") * 100 >= F.col("n_shingles") * min_percent)


def oracle_sql(templates: dict[str, str] = TEMPLATES, min_percent: int = 75) -> str:
    """DuckDB SQL for the exact containment of every notice in every document."""
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in item)) for item in templates.items())
    shingled = """select {id}, unnest(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s
        from (select {id}, regexp_extract_all(lower(text), '[a-z0-9]+') as w from {table}) where len(w) >= 3"""
    return f"""with t(license, text) as (values {values}),
    ts as ({shingled.format(id="license", table="t")}),
    sizes as (select license, count(*) as n_shingles from ts group by license),
    ds as ({shingled.format(id="doc_id", table="documents")})
    select ds.doc_id, ts.license, count(*) as n_found, any_value(n_shingles) as n_shingles
    from ds join ts using (s) join sizes using (license) group by ds.doc_id, ts.license
    having 100 * count(*) >= {min_percent} * any_value(n_shingles)"""
