"""Wording by which licences announce themselves, and wording that only looks like it."""

#: Per family, sentences of its notices and texts. Years, names and versions are examples.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Licensed under the MIT license, see the LICENSE file for details.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 2 or later.",
        "Released under the GPL, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU Affero General Public License version 3",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "bsd": (
        "Licensed under the BSD License.",
        "Released under the 3-Clause BSD License.",
        "This software is distributed under the BSD 2-Clause license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties are disclaimed.',
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0",
    ),
    "public-domain": (
        "This work is released under CC0 1.0 Universal.",
        "This work has been dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License.",
        "Mozilla Public License Version 2.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}

#: Licence wording of no family above.
UNKNOWN = (
    "Licensed under the Example Community License.",
    "Released under the Acme Source License, version 1.",
    "See the LICENSE file for the terms.",
    "This work is licensed under the terms below.",
    "Distributed under a custom license agreement.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This library may be used and distributed under the same terms as the language itself, the Artistic License.",
    "The license of this package is described in the documentation.",
    "Use of this material is subject to the license terms of the vendor.",
    "This software is provided under a license that permits internal use only.",
)

#: Wording that shares words with licences and is none.
OTHER = (
    "The driver renewed the license at the public office in general.",
    "The general public was free to use the software of the library.",
    "She may not use this file and the copy was distributed at school.",
    "The version of the story was published by the foundation in April.",
    "He was granted permission to copy the documents without charge.",
    "The conditions of the work are described in the following list.",
    "Rights and limitations were discussed by the committee.",
    "A copy of the book is available in the library of the university.",
)
