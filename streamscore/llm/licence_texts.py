"""Labelled licence paragraphs: notices and template texts of public licences by family."""

from __future__ import annotations

# Names by which licences are referred to, and their standard notices.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License"],
    "mit": ["MIT License", "MIT license", "MIT", "Expat License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License"],
    "gpl": [
        "GNU General Public License, version 3", "GNU General Public License v2.0", "GPL-3.0-only",
        "GPLv2", "GNU GPL version 2 or later", "GNU General Public License",
    ],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1-or-later", "GNU LGPL", "LGPLv3"],
    "agpl": ["GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL", "AGPLv3"],
    "mpl": ["Mozilla Public License, Version 2.0", "MPL-2.0", "Mozilla Public License 2.0"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "CC BY 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 License", "CC-BY-SA-3.0"],
    "cc-by-nc": [
        "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 License", "CC BY-NC-SA 4.0",
        "CC BY-NC-ND 4.0", "CC-BY-NC-3.0",
    ],
    "public-domain": ["CC0 1.0 Universal", "CC0", "The Unlicense", "public domain"],
}
PHRASES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.",
    "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This project is distributed under the terms of the {}.", "SPDX-License-Identifier: {}",
    "The text of this page is available under the {}.", "License: {}",
    "This software is made available under the {}; see the file LICENSE.",
    "Published under {}, unless otherwise noted.", "Permission is granted under the {}.",
]
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If "
        "not, see <https://www.gnu.org/licenses/>.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation; either version "
        "2.1 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Affero General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "You are free to share and adapt the material for any purpose, even commercially, as long as you "
        "give appropriate credit, provide a link to the license, and indicate if changes were made.",
    ],
    "cc-by-sa": [
        "If you remix, transform, or build upon the material, you must distribute your contributions "
        "under the same license as the original.",
    ],
    "cc-by-nc": ["You may not use the material for commercial purposes."],
    "public-domain": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
OTHERS = [
    "She got her driver's license last week.", "Only licensed professionals may work on the system.",
    "The album was released under great pressure.", "Terms and conditions apply.",
    "The driver lost his licence after the accident.", "All rights reserved.",
    "The general public was invited to the meeting.", "A license fee is due every year.",
    "The software was released in version 2.0 and distributed to users.",
    "Fishing without a licence is not permitted here.", "See the file for the terms of use.",
    "The common people were creative in their work.", "This work is part of a series.",
    "Permission to enter is granted at the gate.", "The public license office is closed.",
    "The foundation published version 3 of its report.", "They met at MIT in the spring.",
    "An apache helicopter flew over the town.", "This project is under construction.",
    "Share this page with your friends.", "The text was written in 2004.",
]
