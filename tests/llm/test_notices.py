"""Real license notices carry their label; altered mandatory wording takes it away."""

import pytest

from tidemark.llm import license_scan

GPL = """
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {0} as published by
 * the Free Software Foundation, either version {1} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {0} for more details.
 *
 * You should have received a copy of the GNU {0}
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def labels(text):
    a = license_scan.Automaton(license_scan.PHRASES + license_scan.NOTICES)
    return {a.templates[k].label for k, _, _ in a.scan(license_scan.words_of(text))}


@pytest.mark.parametrize(("name", "version", "label"), [
    ("General Public License", "3", "gpl-3"), ("General Public License", "2", "gpl-2"), ("Lesser General Public License", "3", "lgpl"),
    ("Lesser General Public License", "2.1", "lgpl"), ("Affero General Public License", "3", "agpl-3"),
])
def test_gnu_notices(name, version, label):
    notice = GPL.format(name, version)
    a = license_scan.Automaton(license_scan.NOTICES)
    found = [(a.templates[k].label, j - i) for k, i, j in a.scan(license_scan.words_of(notice))]
    assert {x for x, _ in found} == {label} and max(n for _, n in found) > 90
    assert labels(notice.split("later version")[0] + "later version.") == {label}


def test_gnu_notice_with_altered_terms():
    assert labels(GPL.format("General Public License", "3").replace("redistribute it and/or modify", "not redistribute it or modify")) == set()


@pytest.mark.parametrize(("text", "label"), [(MIT, "mit"), (ISC, "isc"), (BSD.format(""), "bsd"), (BSD.format(THIRD), "bsd")])
def test_wordings_run_to_their_end(text, label):
    assert labels("before " + text + " after") == {label}
    assert labels(text.replace("LIABLE FOR", "RESPONSIBLE FOR").replace("LIABLE\nFOR", "RESPONSIBLE FOR")) == set()
    assert labels(" ".join(text.split()[:-1])) == set()
