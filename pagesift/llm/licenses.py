"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts are words; shingles are five words in a row.  Windows of a text have a
length of 8, 16, 32, ... words and begin at every eighth of it.  A template
belongs to the shortest length of which it fills seven eighths or less, so one
window holds any occurrence of it as a whole; a template that is contained to
``CONTAINMENT`` then has a Jaccard similarity of at least ``LEAST_JACCARD`` with
that window, for which ``bands_for`` gives the number of bands that misses it
with a probability of at most ``MISS``.  Templates that share a band with a
window are scanned for in the windows that retrieved them: an occurrence is a
stretch of at most five quarters of the template's words that holds enough of
its distinct shingles.

A shingle with a word that no template has is in no template, so windows in which
no template's shingle occurs are not hashed: they cannot share a band.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import bounded_batches, column
from pagesift.llm.decontaminate import blocks_of, word_places, words_of

SHINGLE = 5
CONTAINMENT = 0.8
LEAST_JACCARD = 0.12
MISS = 1e-4
#: Bytes of template text that one task holds; more templates are scanned for in several blocks.
BLOCK_BYTES = 4 << 20

#: Notices that the query looks for (fixed values: wordings of the licenses, their standard headers).
#: What tells versions apart has eight words or fewer: then every shingle has to occur.
#: Punctuation inside long notices is left out, as words are matched without it.
NOTICES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer."
    ),
    "GNU-grant": "can redistribute it and or modify it under the terms of the GNU",
    "GNU-warranty": (
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "GPL-terms": "terms of the GNU General Public License",
    "LGPL-terms": "of the GNU Lesser General Public License",
    "AGPL-terms": "of the GNU Affero General Public License",
    "LGPL-library-terms": "of the GNU Library General Public License",
    "GPL-2.0-version": "GNU General Public License version 2",
    "GPL-2.0-v": "GNU General Public License v2",
    "GPL-3.0-version": "GNU General Public License version 3",
    "GPL-3.0-v": "GNU General Public License v3",
    "LGPL-2.1-version": "GNU Lesser General Public License version 2.1",
    "LGPL-2.1-v": "GNU Lesser General Public License v2.1",
    "LGPL-3.0-version": "GNU Lesser General Public License version 3",
    "LGPL-3.0-v": "GNU Lesser General Public License v3",
    "AGPL-3.0-version": "GNU Affero General Public License version 3",
    "AGPL-3.0-v": "GNU Affero General Public License v3",
    "GNU-version-2-or-later": "either version 2 of the License",
    "GNU-version-2-only": "Free Software Foundation, version 2 of",
    "GNU-version-2.1-or-later": "either version 2.1 of the License",
    "GNU-version-2.1-only": "Free Software Foundation, version 2.1 of",
    "GNU-version-3-or-later": "either version 3 of the License",
    "GNU-version-3-only": "Free Software Foundation, version 3 of",
    "GFDL-1.2": "GNU Free Documentation License, Version 1.2",
    "GFDL-1.3": "GNU Free Documentation License, Version 1.3",
    "CC-BY-4.0-url": "creativecommons.org/licenses/by/4.0/",
    "CC-BY-3.0-url": "creativecommons.org/licenses/by/3.0/",
    "CC-BY-2.0-url": "creativecommons.org/licenses/by/2.0/",
    "CC-BY-SA-4.0-url": "creativecommons.org/licenses/by-sa/4.0/",
    "CC-BY-SA-3.0-url": "creativecommons.org/licenses/by-sa/3.0/",
    "CC-BY-SA-2.0-url": "creativecommons.org/licenses/by-sa/2.0/",
    "CC-BY-NC-4.0-url": "creativecommons.org/licenses/by-nc/4.0/",
    "CC-BY-NC-3.0-url": "creativecommons.org/licenses/by-nc/3.0/",
    "CC-BY-NC-2.0-url": "creativecommons.org/licenses/by-nc/2.0/",
    "CC-BY-ND-4.0-url": "creativecommons.org/licenses/by-nd/4.0/",
    "CC-BY-ND-3.0-url": "creativecommons.org/licenses/by-nd/3.0/",
    "CC-BY-ND-2.0-url": "creativecommons.org/licenses/by-nd/2.0/",
    "CC-BY-NC-SA-4.0-url": "creativecommons.org/licenses/by-nc-sa/4.0/",
    "CC-BY-NC-SA-3.0-url": "creativecommons.org/licenses/by-nc-sa/3.0/",
    "CC-BY-NC-SA-2.0-url": "creativecommons.org/licenses/by-nc-sa/2.0/",
    "CC-BY-NC-ND-4.0-url": "creativecommons.org/licenses/by-nc-nd/4.0/",
    "CC-BY-NC-ND-3.0-url": "creativecommons.org/licenses/by-nc-nd/3.0/",
    "CC-BY-NC-ND-2.0-url": "creativecommons.org/licenses/by-nc-nd/2.0/",
    "GPL-2.0-kernel": (
        "This software is licensed under the terms of the GNU General Public License version 2, as published by "
        "the Free Software Foundation, and may be copied, distributed, and modified under those terms."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2 0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2 0/."
    ),
    "MPL-2.0-licensed": "Licensed under the Mozilla Public License, version 2 0.",
    "MPL-2.0-released": "Released under the Mozilla Public License 2.0.",
    "MPL-1.1-header": (
        'The contents of this file are subject to the Mozilla Public License Version 1 1 the License"); you may '
        'not use this file except in compliance with the License. You may obtain a copy of the License at http '
        'www mozilla org MPL/'
    ),
    "ISC-0BSD-permission": (
        "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies."
    ),
    "ISC-disclaimer": (
        'THE SOFTWARE IS PROVIDED AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        'INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE '
        'FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM '
        'LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, '
        'ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ),
    "ISC-licensed": "This software is licensed under the ISC License.",
    "ISC-released": "Released under the terms of the ISC License.",
    "EPL-1.0-header": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of "
        "the Eclipse Public License v1 0 which accompanies this distribution, and is available at http www "
        "eclipse org legal epl v10 html"
    ),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2 0 which is available at https www eclipse org legal epl 2 0/"
    ),
    "EPL-2.0-licensed": "Licensed under the Eclipse Public License, version 2 0.",
    "CDDL-1.0-header": (
        'The contents of this file are subject to the terms of the Common Development and Distribution License '
        'the License"). You may not use this file except in compliance with the License.'
    ),
    "EUPL-1.2-header": (
        'Licensed under the EUPL, Version 1 2 or - as soon they will be approved by the European Commission - '
        'subsequent versions of the EUPL the Licence"); You may not use this work except in compliance with the '
        'Licence.'
    ),
    "MIT-disclaimer": (
        'THE SOFTWARE IS PROVIDED AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        'LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN '
        'NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, '
        'WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE '
        'SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-terms": "This software is distributed under the terms of the MIT license.",
    "MIT-use": (
        "Use of this source code is governed by an MIT style license that can be found in the LICENSE file."
    ),
    "Apache-2.0-project": "This project is licensed under the Apache License 2 0.",
    "Apache-2.0-released": "Released under the Apache License, Version 2.0.",
    "Apache-2.0-ASF": (
        'Licensed to the Apache Software Foundation ASF) under one or more contributor license agreements. See '
        'the NOTICE file distributed with this work for additional information regarding copyright ownership. '
        'The ASF licenses this file to You under the Apache License, Version 2 0 the License"); you may not use '
        'this file except in compliance with the License.'
    ),
    "BSD-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution."
    ),
    "BSD-3-Clause-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "BSD-4-Clause-advertising": (
        "All advertising materials mentioning features or use of this software must display the following "
        "acknowledgement: This product includes software developed by"
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS" AND ANY EXPRESS OR IMPLIED '
        'WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        'PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR '
        'ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES INCLUDING, BUT NOT '
        'LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS '
        'INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR '
        'TORT INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF '
        'ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    ),
    "BSD-style": (
        "Use of this source code is governed by a BSD style license that can be found in the LICENSE file."
    ),
    "BSD-2-Clause-licensed": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-licensed": "Licensed under the BSD 3-Clause License.",
    "Zlib-permission": (
        "This software is provided as is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:"
    ),
    "BSL-1.0-header": (
        "Distributed under the Boost Software License, Version 1 0. See accompanying file LICENSE 1 0 txt or "
        "copy at http www boost org LICENSE 1 0 txt)"
    ),
    "BSL-1.0-permission": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the '
        'software and accompanying documentation covered by this license the Software") to use, reproduce, '
        'display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
        'Software, and to permit third parties to whom the Software is furnished to do so.'
    ),
    "Unlicense-notice": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non commercial, and by any means."
    ),
    "WTFPL-terms": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and "
        "changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE "
        "TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"
    ),
    "Artistic-2.0-licensed": "This is free software, licensed under the Artistic License 2 0.",
    "Perl-terms": (
        "This is free software; you can redistribute it and or modify it under the same terms as the Perl 5 "
        "programming language system itself."
    ),
    "CC0-1.0-notice": (
        "To the extent possible under law, the author s) have dedicated all copyright and related and "
        "neighboring rights to this software to the public domain worldwide. This software is distributed "
        "without any warranty."
    ),
    "CC0-1.0-waived": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright "
        "and related or neighboring rights to this work."
    ),
    "CC0-1.0-licensed": "This work is marked with CC0 1 0 Universal.",
    "CC0-1.0-released": "Released under the CC0 1 0 Universal Public Domain Dedication.",
    "public-domain": "This work has been released into the public domain by its author.",
    "OFL-1.1-header": "This Font Software is licensed under the SIL Open Font License, Version 1 1.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4 0 International License.",
    "CC-BY-4.0-the": (
        "This work is licensed under the Creative Commons Attribution 4 0 International License."
    ),
    "CC-BY-4.0-terms": "Available under the terms of the Creative Commons Attribution 4 0 license.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-3.0-work": "This work is licensed under a Creative Commons Attribution 3 0 Unported License.",
    "CC-BY-3.0-the": "This work is licensed under the Creative Commons Attribution 3 0 Unported License.",
    "CC-BY-3.0-terms": "Available under the terms of the Creative Commons Attribution 3 0 license.",
    "CC-BY-3.0-short": "Licensed under CC BY 3.0.",
    "CC-BY-SA-4.0-work": (
        "This work is licensed under a Creative Commons Attribution ShareAlike 4 0 International License."
    ),
    "CC-BY-SA-4.0-the": (
        "This work is licensed under the Creative Commons Attribution ShareAlike 4 0 International License."
    ),
    "CC-BY-SA-4.0-terms": "Available under the terms of the Creative Commons Attribution ShareAlike 4 0 license.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-3.0-work": (
        "This work is licensed under a Creative Commons Attribution ShareAlike 3 0 Unported License."
    ),
    "CC-BY-SA-3.0-the": (
        "This work is licensed under the Creative Commons Attribution ShareAlike 3 0 Unported License."
    ),
    "CC-BY-SA-3.0-terms": "Available under the terms of the Creative Commons Attribution ShareAlike 3 0 license.",
    "CC-BY-SA-3.0-short": "Licensed under CC BY-SA 3.0.",
    "CC-BY-NC-4.0-work": (
        "This work is licensed under a Creative Commons Attribution NonCommercial 4 0 International License."
    ),
    "CC-BY-NC-4.0-the": (
        "This work is licensed under the Creative Commons Attribution NonCommercial 4 0 International License."
    ),
    "CC-BY-NC-4.0-terms": (
        "Available under the terms of the Creative Commons Attribution NonCommercial 4 0 license."
    ),
    "CC-BY-NC-3.0-work": (
        "This work is licensed under a Creative Commons Attribution NonCommercial 3 0 Unported License."
    ),
    "CC-BY-NC-3.0-the": (
        "This work is licensed under the Creative Commons Attribution NonCommercial 3 0 Unported License."
    ),
    "CC-BY-NC-3.0-terms": (
        "Available under the terms of the Creative Commons Attribution NonCommercial 3 0 license."
    ),
    "CC-BY-NC-3.0-short": "Licensed under CC BY-NC 3.0.",
    "CC-BY-ND-4.0-work": (
        "This work is licensed under a Creative Commons Attribution NoDerivatives 4 0 International License."
    ),
    "CC-BY-ND-4.0-the": (
        "This work is licensed under the Creative Commons Attribution NoDerivatives 4 0 International License."
    ),
    "CC-BY-ND-4.0-terms": (
        "Available under the terms of the Creative Commons Attribution NoDerivatives 4 0 license."
    ),
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-3.0-work": (
        "This work is licensed under a Creative Commons Attribution NoDerivatives 3 0 Unported License."
    ),
    "CC-BY-ND-3.0-the": (
        "This work is licensed under the Creative Commons Attribution NoDerivatives 3 0 Unported License."
    ),
    "CC-BY-ND-3.0-terms": (
        "Available under the terms of the Creative Commons Attribution NoDerivatives 3 0 license."
    ),
    "CC-BY-ND-3.0-short": "Licensed under CC BY-ND 3.0.",
    "CC-BY-NC-SA-4.0-work": (
        "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4 0 International "
        "License."
    ),
    "CC-BY-NC-SA-4.0-the": (
        "This work is licensed under the Creative Commons Attribution NonCommercial ShareAlike 4 0 International "
        "License."
    ),
    "CC-BY-NC-SA-4.0-terms": (
        "Available under the terms of the Creative Commons Attribution NonCommercial ShareAlike 4 0 license."
    ),
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-3.0-work": (
        "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 3 0 Unported "
        "License."
    ),
    "CC-BY-NC-SA-3.0-the": (
        "This work is licensed under the Creative Commons Attribution NonCommercial ShareAlike 3 0 Unported "
        "License."
    ),
    "CC-BY-NC-SA-3.0-terms": (
        "Available under the terms of the Creative Commons Attribution NonCommercial ShareAlike 3 0 license."
    ),
    "CC-BY-NC-SA-3.0-short": "Licensed under CC BY-NC-SA 3.0.",
    "CC-BY-NC-ND-4.0-work": (
        "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4 0 "
        "International License."
    ),
    "CC-BY-NC-ND-4.0-the": (
        "This work is licensed under the Creative Commons Attribution NonCommercial NoDerivatives 4 0 "
        "International License."
    ),
    "CC-BY-NC-ND-4.0-terms": (
        "Available under the terms of the Creative Commons Attribution NonCommercial NoDerivatives 4 0 license."
    ),
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-3.0-work": (
        "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 3 0 Unported "
        "License."
    ),
    "CC-BY-NC-ND-3.0-the": (
        "This work is licensed under the Creative Commons Attribution NonCommercial NoDerivatives 3 0 Unported "
        "License."
    ),
    "CC-BY-NC-ND-3.0-terms": (
        "Available under the terms of the Creative Commons Attribution NonCommercial NoDerivatives 3 0 license."
    ),
    "CC-BY-NC-ND-3.0-short": "Licensed under CC BY-NC-ND 3.0.",
    "GPL-2.0-only-SPDX": "SPDX-License-Identifier: GPL-2.0-only",
    "GPL-2.0-or-later-SPDX": "SPDX-License-Identifier: GPL-2.0-or-later",
    "GPL-3.0-only-SPDX": "SPDX-License-Identifier: GPL-3.0-only",
    "GPL-3.0-or-later-SPDX": "SPDX-License-Identifier: GPL-3.0-or-later",
    "LGPL-2.1-only-SPDX": "SPDX-License-Identifier: LGPL-2.1-only",
    "LGPL-2.1-or-later-SPDX": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "LGPL-3.0-only-SPDX": "SPDX-License-Identifier: LGPL-3.0-only",
    "LGPL-3.0-or-later-SPDX": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "AGPL-3.0-only-SPDX": "SPDX-License-Identifier: AGPL-3.0-only",
    "AGPL-3.0-or-later-SPDX": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "Apache-2.0-SPDX": "SPDX-License-Identifier: Apache-2.0",
    "MPL-2.0-SPDX": "SPDX-License-Identifier: MPL-2.0",
    "EPL-2.0-SPDX": "SPDX-License-Identifier: EPL-2.0",
    "BSL-1.0-SPDX": "SPDX-License-Identifier: BSL-1.0",
    "BSD-2-Clause-SPDX": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause-SPDX": "SPDX-License-Identifier: BSD-3-Clause",
    "CC0-1.0-SPDX": "SPDX-License-Identifier: CC0-1.0",
    "CC-BY-4.0-SPDX": "SPDX-License-Identifier: CC-BY-4.0",
    "CC-BY-SA-4.0-SPDX": "SPDX-License-Identifier: CC-BY-SA-4.0",
    "Artistic-2.0-SPDX": "SPDX-License-Identifier: Artistic-2.0",
}


def bands_for(jaccard: float, rows: int = 1, miss: float = MISS) -> int:
    """Bands of ``rows`` hashes that miss a pair of this similarity with at most the given probability."""
    return math.ceil(math.log(miss) / math.log1p(-(jaccard**rows)))


def window_words(words: int) -> int:
    """The shortest window length of which so many words fill seven eighths or less."""
    size = 8
    while words > size * 7 // 8:
        size *= 2
    return size


def shingles(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit value for each ``size`` ids in a row."""
    values = ids.astype(np.uint64) + np.uint64(1)
    out = np.zeros(max(0, len(values) - size + 1), np.uint64)
    for k in range(size):
        out = mixed(out ^ values[k : k + len(out)] * np.uint64(0x9E3779B97F4A7C15))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits (finaliser of splitmix64; fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Matcher:
    """Templates and the scan of one text; templates of fewer than five words are one shingle of their own size."""

    def __init__(self, templates: list[tuple[str, str]], containment: float = CONTAINMENT) -> None:
        self.names, self.vocabulary = [], {}
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for name, text in sorted(templates):
            if words := words_of(text):
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
                by_size[min(SHINGLE, len(ids))].append((len(self.names), ids))
                self.names.append(name)
        self.parts = [Part(size, own, containment) for size, own in sorted(by_size.items())]

    def scan(self, text: str) -> list[tuple[int, int, int, float]]:
        """Occurrences: template, first word, last word, containment; ascending by first word, then template."""
        words = words_of(text)
        if not self.parts or len(words) < self.parts[0].size:
            return []
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
        concerned = [part for part in self.parts if part.concerns(ids)]
        if not concerned:
            return []
        # Words that no template has still tell shingles of the windows apart.
        own: dict[bytes, int] = {}
        for i in np.flatnonzero(ids == 0).tolist():
            ids[i] = len(self.vocabulary) + 1 + own.setdefault(words[i], len(own))
        return sorted((f for part in concerned for f in part.scan(ids)), key=lambda f: (f[1], f[0]))


class Part:
    """Templates of one shingle size with their bands."""

    def __init__(self, size: int, templates: list[tuple[int, np.ndarray]], containment: float) -> None:
        self.size, self.containment = size, containment
        self.words = {number: len(ids) for number, ids in templates}
        self.sets = {number: np.unique(shingles(ids, size)) for number, ids in templates}
        self.seeds = mixed(np.arange(1, bands_for(LEAST_JACCARD) + 1, dtype=np.uint64))[:, None]
        self.every = np.unique(np.concatenate(list(self.sets.values())))
        self.bands: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for number, own in self.sets.items():
            for band, value in enumerate(self.minima(own).tolist()):
                self.bands[window_words(self.words[number]), band, value].append(number)
        self.windows = sorted({window_words(n) for n in self.words.values()})

    def concerns(self, ids: np.ndarray) -> bool:
        """Whether a template's shingle occurs; ``ids`` are zero for words that no template has."""
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        values = shingles(ids, self.size)
        return bool(np.isin(values[unknown[self.size :] == unknown[: len(values)]], self.every).any())

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        values = shingles(ids, self.size)
        retrieved = self.retrieve(values)
        return [f for number, windows in retrieved.items() for f in self.verify(number, values, windows)]

    def minima(self, values: np.ndarray) -> np.ndarray:
        return mixed(values[None, :] ^ self.seeds).min(axis=1)

    def retrieve(self, values: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template the windows (first and past the last shingle) that share a band with it."""
        hits = np.flatnonzero(np.isin(values, self.every))
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size in self.windows:
            step, reach = size // 8, size - self.size + 1
            starts = {s for h in hits.tolist() for s in range(max(0, -(-(h - reach + 1) // step)), h // step + 1)}
            for start in sorted(starts):
                first = start * step
                part = values[first : first + reach]
                here = {t for b, v in enumerate(self.minima(part).tolist()) for t in self.bands.get((size, b, v), ())}
                for number in here:
                    out[number].append((first, first + len(part)))
        return out

    def verify(self, number: int, values: np.ndarray, windows: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
        """Occurrences inside the windows, from the left, none over another."""
        own = self.sets[number]
        inside = np.zeros(len(values), bool)
        for first, end in windows:
            inside[first:end] = True
        places = np.flatnonzero(np.isin(values, own) & inside)
        return occurrences(places, values, len(own), self.words[number], self.containment, number)


def occurrences(places, values, distinct: int, words: int, least: float, number: int) -> list[tuple[int, int, int, float]]:
    found, at = [], 0
    size = min(SHINGLE, words)
    reach = max(words, words * 5 // 4) - size + 1
    places = places.tolist()
    while at < len(places):
        seen, stop = set(), at
        best = None
        while stop < len(places) and places[stop] < places[at] + reach:
            value = int(values[places[stop]])
            if value not in seen:
                seen.add(value)
                if len(seen) >= least * distinct - 1e-9:
                    best = stop  # up to the last shingle that is new
            stop += 1
        if best is None:
            at += 1
            continue
        share = len({int(values[p]) for p in places[at : best + 1]}) / distinct
        found.append((number, places[at], places[best] + size - 1, share))
        while at < len(places) and places[at] <= found[-1][2]:
            at += 1
    return found


MATCHES = "array<struct<license_id: string, start: int, end: int, containment: double>>"


def matcher_udf(spark: SparkSession, templates: DataFrame, containment: float):
    shared = spark.sparkContext.broadcast([(r.item, r.text) for r in templates.toLocalIterator()])
    kind = pa.list_(
        pa.struct([("license_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())])
    )

    @F.arrow_udf(MATCHES)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value, containment)
        for batch in batches:
            out = []
            for text in batch:
                text = text.as_py() or ""
                found = matcher.scan(text)
                at = word_places(text) if found else None
                out.append([
                    {"license_id": matcher.names[n], "start": int(at[a, 0]), "end": int(at[b, 1]), "containment": c}
                    for n, a, b, c in found
                ])
            yield pa.array(out, kind)

    return match


def license_matches(
    docs: DataFrame,
    templates: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    license_col: str = "license_id",
    template_col: str = "text",
    containment: float = CONTAINMENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per occurrence: ``doc_id, license_id, start, end, containment``; places in code points, end exclusive.

    ``containment`` is the share of the template's distinct shingles (of five words;
    a shorter template is one shingle) inside the occurrence.  Occurrences of one
    template do not overlap; those of different templates can.  Templates with a null
    id or text, or without words, match nothing.  Null and empty texts have no
    occurrence, repeated rows have theirs repeatedly, null ids are carried along.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = []
    for block in blocks_of(templates, license_col, template_col, block_bytes):
        match = matcher_udf(spark, block, containment)
        found = docs.select(column(id_col).alias("doc_id"), F.explode(match(column(text_col))).alias("m"))
        parts.append(found.select("doc_id", "m.*"))
    return reduce(DataFrame.unionByName, parts)


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "license_id string, text string")
