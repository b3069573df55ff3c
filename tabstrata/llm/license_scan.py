"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

Texts and templates are words; a shingle is five words. Templates are classed by length (powers of
two). For a class of up to L words, a text is read in windows of 2L shingles that advance by L, so
every occurrence lies in some window whole. A window and a template that share ``threshold`` of the
template's shingles have a Jaccard similarity of at least J = threshold * s / (2L + (1 - threshold) * s),
s being the template's shingles; the number of one-row bands is chosen so that 1 - (1 - J) ** bands is at
least ``collide`` for every template of the class. A template retrieved for a window is verified by
the exact share of its shingles that stand in the window.

Scale: one pass over the documents without shuffle; the templates (bounded, checked) are sent to
the workers. Window minima are taken by numpy over whole batches. Very long texts are only more windows.

Cases: null and empty texts match nothing; a text shorter than a window is one window; templates of
fewer than five words cannot be matched and are refused; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabstrata.llm.common import Words, bounded_batches, mix, power_of_two, shingle_hashes, slices, text_buffer

SHINGLE = 5
MAX_TEMPLATES = 10_000
_GAP = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])

#: Customary license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "bsd-header": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted"
    ),
    "mit": "Released under the MIT License.",
    "mit-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "warranty": (
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ),
}


def _shingles(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]), _GAP)
    return shingle_hashes(words.hashes(), words.at, SHINGLE)[0]


class TemplateIndex:
    """Templates by length class, with the minima of their bands."""

    def __init__(self, templates: dict[str, str], threshold: float, collide: float):
        self.threshold = threshold
        self.classes: list[tuple[int, int, np.ndarray, np.ndarray, list, list]] = []
        grouped: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, text in sorted(templates.items()):
            raw = np.frombuffer(text.encode(), np.uint8)
            words = len(Words(raw, np.array([0, len(raw)]), _GAP).start)
            if words < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            grouped.setdefault(power_of_two(words, 8), []).append((name, np.unique(_shingles(text))))
        for size, members in sorted(grouped.items()):
            window = 2 * size
            least = min(threshold * len(s) / (window + (1 - threshold) * len(s)) for _, s in members)
            bands = int(np.ceil(np.log(1 - collide) / np.log(1 - least)))
            seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(2862933555777941757)) | np.uint64(1)
            keys, which = [], []
            for i, (_, s) in enumerate(members):
                keys.append([_permute(s, seed).min() for seed in seeds])
                which.append(i)
            self.classes.append((size, window, seeds, np.array(keys), [n for n, _ in members], [s for _, s in members]))


def _permute(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = h * seed
    return x ^ (x >> np.uint64(29))


def scan_slice(index: TemplateIndex, shingles: np.ndarray, at: np.ndarray) -> list[tuple[int, str, float]]:
    """(text, template, containment) of the verified matches in some texts, best window of each."""
    best: dict[tuple[int, str], float] = {}
    count = np.diff(at)
    for size, window, seeds, keys, names, sets in index.classes:
        # windows start every ``size`` shingles and cover two such strides
        pieces = -(-count // size)
        first = np.concatenate([[0], np.cumsum(pieces)])
        if not first[-1]:
            continue
        owner = np.repeat(np.arange(len(count)), pieces)
        start = at[:-1][owner] + (np.arange(first[-1]) - first[:-1][owner]) * size
        end = np.minimum(start + 2 * size, at[1:][owner])
        hits: list[np.ndarray] = []
        last = np.concatenate([owner[1:] != owner[:-1], [True]])
        for seed, column in zip(seeds, keys.T):
            low = np.minimum.reduceat(_permute(shingles, seed), start)
            both = np.where(last, low, np.minimum(low, np.concatenate([low[1:], low[-1:]])))
            order = np.argsort(column)
            place = np.minimum(np.searchsorted(column[order], both), len(column) - 1)
            found = np.flatnonzero(column[order][place] == both)
            for w in found:
                for i in np.flatnonzero(column == both[w]):
                    hits.append((int(w), int(i)))
        for w, i in set(hits):
            inside = np.isin(sets[i], shingles[start[w] : end[w]]).sum()
            share = inside / len(sets[i])
            if share >= index.threshold:
                key = (int(owner[w]), names[i])
                best[key] = max(best.get(key, 0.0), float(share))
    return [(d, name, share) for (d, name), share in sorted(best.items())]


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = 0.8,
    collide: float = 0.9999,
) -> DataFrame:
    """Per document: doc_id, n_matches, licenses (sorted template names), containment (of each)."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates; scan them in parts")
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(TemplateIndex(templates, threshold, collide))

    def task(batches):
        index = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            names = [[] for _ in range(batch.num_rows)]
            shares = [[] for _ in range(batch.num_rows)]
            for a, b in slices(offsets):
                words = Words(data, offsets[a : b + 1], _GAP)
                shingles, at = shingle_hashes(words.hashes(), words.at, SHINGLE)
                for d, name, share in scan_slice(index, shingles, at):
                    names[a + d].append(name)
                    shares[a + d].append(share)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(shares, pa.list_(pa.float64())),
                ],
                names=["doc_id", "n_matches", "licenses", "containment"],
            )

    schema = "doc_id bigint, n_matches bigint, licenses array<string>, containment array<double>"
    return docs.select("doc_id", "text").mapInArrow(task, schema)
