"""Templates of common licenses for ``licenses``: notices, and the full texts of short licenses.

Fixed values: the wordings are those of the licenses.
"""

_NAMED = "<<either;work|software|program|project|document|text|file|package>>"
_GRANT = "<<either;licensed|released|distributed|available|published>> under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>>"


def _gnu(name: str, version: int) -> str:
    return f"""{_NAMED} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation,
either version {version} of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version"""


_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY <<var;words=1..20>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words=1..20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""

TEMPLATES = [
    ("mit", f"{_GRANT} MIT License"),
    (
        "mit",
        """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=1..20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """
Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1..10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL <<var;words=1..10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("bsd-2", _BSD + _DISCLAIMER),
    (
        "bsd-3",
        _BSD
        + """
<<beginOptional>>3<<endOptional>> Neither the name of <<var;words=1..20>> nor the names of <<either;its|their|other>> contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
        + _DISCLAIMER,
    ),
    ("apache-2", f"{_GRANT} Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("gpl-2", f"{_GRANT} <<either;GNU General Public License|GNU GPL|GPL>> <<either;version 2|v2|2>>"),
    ("gpl-3", f"{_GRANT} <<either;GNU General Public License|GNU GPL|GPL>> <<either;version 3|v3|3>>"),
    ("gpl-2-or-later", _gnu("General Public License", 2)),
    ("gpl-3-or-later", _gnu("General Public License", 3)),
    ("lgpl-3-or-later", _gnu("Lesser General Public License", 3)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", f"{_GRANT} <<either;CC BY|Creative Commons Attribution>> <<beginOptional>>International<<endOptional>> <<either;2 0|2 5|3 0|4 0>>"),
    ("cc-by-sa", f"{_GRANT} <<either;CC BY SA|Creative Commons Attribution ShareAlike|Creative Commons Attribution Share Alike>> <<either;2 0|2 5|3 0|4 0>>"),
    ("cc-by-nc", f"{_GRANT} <<either;CC BY NC|Creative Commons Attribution NonCommercial|Creative Commons Attribution Non Commercial>> <<either;2 0|2 5|3 0|4 0>>"),
    ("cc0", f"{_GRANT} <<either;CC0|Creative Commons Zero>> <<beginOptional>>1.0<<endOptional>> <<either;license|universal|dedication>>"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
