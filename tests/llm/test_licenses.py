"""Licence scan: phrases against a plain search, notices by cases, the query against its SQL."""

import re

import duckdb
import pandas as pd

from claimscope.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
TEXTS = [
    None, "", " ,. ", "MIT License", "the mit license; MIT-LICENSE mit  license", "mit the license", "GNU General\nPublic License, version 3.", "gnu gnu general public license license", "cc by cc by cc", "CC BY-NC 4.0",
    "Licensed under the Apache License, Version 2.0.", "apache licensé", "é mit license é", "mIt lİcense", MIT, MIT.replace("associated ", ""), MIT.replace("hereby", "here"), "İ ẞ ſ MIT license", "x" * 20000 + " mit license",
    "mit license " * 3000, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "license", "permission fee granted hereby",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "mit\x00license mit license", "MİT LICENSE",
]


def base(text):
    """Words and the base phrases' places, by the definition."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(k, label) for label, phrase in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def _scan(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, words string").repartition(3)
    return {r.doc_id: r for r in licenses.license_scan(docs).collect()}


def test_base_equals_the_definition(spark):
    got = _scan(spark, TEXTS)
    assert [tuple(got[k])[1:6] for k in range(len(TEXTS))] == [base(t) for t in TEXTS]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_notices(spark):
    got = {TEXTS[k]: r for k, r in _scan(spark, TEXTS).items()}
    assert (got[MIT].labels, got[MIT].score) == ("mit", 1.0)
    assert got[MIT.replace("associated ", "")].labels == "mit"  # a word is missing
    assert got[MIT.replace("hereby", "here")].labels == ""  # a mandatory phrase is broken
    assert got["Licensed under the Apache License, Version 2.0."].labels == "apache,apache-2.0"
    assert got["CC BY-NC 4.0"].labels == "cc-by,cc-by-nc"
    assert got["GNU General\nPublic License, version 3."].labels == "gpl,gpl-3.0"
    assert [got[t].labels for t in TEXTS if t and t.startswith("Redistribution")] == ["bsd"]
    assert got["license"].score == 0.0


def test_equals_sql(spark):
    docs = pd.DataFrame({"doc_id": [*range(len(TEXTS)), None], "text": [*TEXTS, MIT]}).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.sql(licenses.ORACLE).df()
    rows = [(int(k) if not pd.isna(k) else None, t) for k, t in docs.itertuples(index=False)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    plain = lambda f: sorted((tuple("" if pd.isna(v) else str(v) if isinstance(v, str) else float(v) for v in r) for r in f[sorted(want.columns)].itertuples(index=False)), key=repr)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_plan_is_native_and_keeps_documents_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = licenses.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange|Join", plan)


def test_every_template_finds_itself(spark):
    of = licenses.templates()
    got = _scan(spark, [" ".join(t.words) for t in of])
    assert [t.label in got[k].labels.split(",") for k, t in enumerate(of)] == [True] * len(of)


def test_empty_table(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
