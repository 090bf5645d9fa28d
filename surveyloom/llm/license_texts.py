"""Full texts and standard headers of common licences, with and without titles and appendices."""

from __future__ import annotations

import re
from pathlib import Path

FOLDER = Path(__file__).parent / "licenses"
# Where a stored text begins after its title, and where its appendix begins.
PARTS = {
    "Apache-2.0": ("TERMS AND CONDITIONS FOR USE", "APPENDIX: How to apply"),
    "GPL-2.0": ("Everyone is permitted to copy", "How to Apply These Terms"),
    "GPL-3.0": ("Everyone is permitted to copy", "How to Apply These Terms"),
    "MPL-2.0": ("1. Definitions", "Exhibit A - Source Code"),
    "CC0-1.0": ("Statement of Purpose", None),
}
# The first and the last words of the header that a stored text asks for.
HEADERS = {
    "Apache-2.0": ("Licensed under the Apache License", "limitations under the License."),
    "GPL-2.0": ("This program is free software", "Boston, MA 02110-1301 USA."),
    "GPL-3.0": ("This program is free software", "<https?://www.gnu.org/licenses/>."),
    "MPL-2.0": ("This Source Code Form is subject", "https?://mozilla.org/MPL/2.0/."),
}
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"),
}
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def full_texts(short: tuple) -> list[tuple[str, str]]:
    """Names and texts; ``short`` has the names and texts of licences that are one paragraph."""
    bodies = [(n, t) for n, t in short if n in TITLES]
    for name, clauses in (("BSD-2-Clause", (_SOURCE, _BINARY)), ("BSD-3-Clause", (_SOURCE, _BINARY, _NAMES))):
        for holder in ("HOLDER", "HOLDERS"):
            for mark in ("{}. ", ""):
                listed = [mark.format(i) + c for i, c in enumerate(clauses, 1)]
                bodies.append((name, " ".join([_BSD, *listed, _AS_IS.format(holder)])))
    out = bodies + [(n, f"{title}\n\n{body}") for n, body in bodies for title in TITLES[n]]
    for name, (start, appendix) in PARTS.items():
        text = (FOLDER / f"{name}.txt").read_text(encoding="utf-8")
        ends = [len(text)] + ([text.index(appendix)] if appendix else [])
        out += [(name, text[at:end]) for at in (0, text.index(start)) for end in ends]
        if name in HEADERS:
            first, last = HEADERS[name]
            out += [(name, m) for m in re.findall(f"{first}.*?{last}", text, re.DOTALL)[:1]]
    # links are written with either scheme
    return out + [(n, re.sub("https?://", scheme, x)) for n, x in out for scheme in ("http://", "https://") if "://" in x]
