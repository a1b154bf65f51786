"""Wordings of public licences and notices, each with its label and the phrase that must stand in it."""

_PERMISSIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the {name} for more details."""
_CREATIVE = "This work is licensed under a Creative Commons {name} 4.0 International License."

LICENCES = [
    ("mit", "under the MIT license", "mit license"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
        "permission to use copy modify and or distribute this software for any purpose",
    ),
    ("bsd-2", f"{_PERMISSIONS} {_DISCLAIMER}", "redistribution and use in source and binary forms"),
    ("bsd-3", f"{_PERMISSIONS} {_ENDORSEMENT} {_DISCLAIMER}", "may be used to endorse or promote products derived from this software"),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely.""",
        "permission is granted to anyone to use this software for any purpose",
    ),
    (
        "bsl-1",
        """Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy
        of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software.""",
        "to any person or organization obtaining a copy of the software",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
        any means.""",
        "free and unencumbered software released into the public domain",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache license version 2"),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
        may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied.""",
        "apache license version 2",
    ),
    ("gpl-2", _GNU.format(name="GNU General Public License", version="2"), "either version 2 of the license"),
    ("gpl-3", _GNU.format(name="GNU General Public License", version="3"), "gnu general public license as published by the free software foundation either version 3"),
    ("lgpl-3", _GNU.format(name="GNU Lesser General Public License", version="3"), "gnu lesser general public license"),
    ("agpl-3", _GNU.format(name="GNU Affero General Public License", version="3"), "gnu affero general public license"),
    ("gpl-3", "licensed under the GNU General Public License version 3", "gnu general public license version 3"),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "mozilla public license v 2 0",
    ),
    ("cc-by", _CREATIVE.format(name="Attribution"), "creative commons attribution 4 0"),
    ("cc-by-sa", _CREATIVE.format(name="Attribution-ShareAlike"), "creative commons attribution sharealike 4 0"),
    ("cc-by-nc", _CREATIVE.format(name="Attribution-NonCommercial"), "creative commons attribution noncommercial 4 0"),
    ("cc-by-nc-sa", _CREATIVE.format(name="Attribution-NonCommercial-ShareAlike"), "creative commons attribution noncommercial sharealike 4 0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc"),
    (
        "cc0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0
        Universal Public Domain Dedication.""",
        "waived all copyright and related or neighboring rights",
    ),
    ("all-rights-reserved", "All rights reserved", "all rights reserved"),
]
