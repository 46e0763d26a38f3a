import re

import pytest

pytest.importorskip("public_tokenizers")

from corpus import SCHEMA, frame
from weftgraph.llm import licenses

NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:",
    "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0.",
    "Released under\n\nthe MIT\nLicense",
    "released one two three four five\nunder six seven eight nine ten the\none two three mit",
    "Permission is granted\nto copy",
    "",
    None,
]


def brute(text):
    words = [w.lower() for w in re.findall(r"[0-9A-Za-z]+", text or "")]
    lines = [{w.lower() for w in re.findall(r"[0-9A-Za-z]+", x)} for x in (text or "").split("\n")]
    hits = {}
    for label, templates in licenses.TEMPLATES.items():
        for own in (t.split() for t in templates):
            n = next(n for n in range(len(own), 1000) if n * licenses.THRESHOLD >= len(own) - 1e-9)
            for block in lines + [set(words[i : i + n]) for i in range(len(words))]:
                share = len(set(own) & block) / len(set(own))
                if share >= licenses.THRESHOLD:
                    hits[label] = max(share, hits.get(label, 0))
    return ",".join(sorted(hits)), max(hits.values(), default=0.0)


def test_wrapped_notices(spark):
    filler = "plain words of no licence at all\n" * 40
    texts = [*NOTICES, *(filler + (n or "") + "\n" + filler for n in NOTICES), "\n".join(n or "" for n in NOTICES)]
    docs = frame(spark, [(i, t, None, "s", None, "", "", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scanned(docs).collect()}
    assert docs.schema.names == [x.split()[0] for x in SCHEMA.split(", ")] and got == {i: brute(t) for i, t in enumerate(texts)}
    assert [got[i] for i in range(8)] == [("mit", 1.0), ("bsd", 1.0), ("mpl-2.0", 1.0), ("mit", 1.0), ("", 0.0), ("", 0.0), ("", 0.0), ("", 0.0)]
