"""Notices and harmless lines, written before the model was changed to find more of them; not to be adapted to it."""

NOTICES = [
    ("mit", "License: MIT"),
    ("mit", "MIT License\n\nCopyright (c) 2019 Jane Roe"),
    ("mit", "The software is distributed under the MIT license, a copy of which is in LICENSE.txt."),
    ("mit", 'license = { text = "MIT" }'),
    ("mit", '"license": "MIT",'),
    ("mit", "All code samples on this site are MIT licensed."),
    ("mit", "# SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"),
    ("mit", "[MIT](LICENSE) license, do what you want"),
    ("apache", "Licensed to the Apache Software Foundation (ASF) under one or more\ncontributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0"),
    ("apache", "License: Apache-2.0"),
    ("apache", 'license = "Apache-2.0"'),
    ("apache", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"),
    ("apache", "This plugin is available under the Apache License 2.0."),
    ("apache", "// SPDX-License-Identifier: Apache-2.0"),
    ("apache", "Unless required by applicable law, software distributed under the Apache License is distributed on an AS IS basis"),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Our data sets are released under Apache 2.0, models included."),
    ("gpl", "This file is part of Foo.\n\nFoo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("gpl", "Code is GPLv3; see COPYING"),
    ("gpl", "License: GPL-2.0-or-later"),
    ("gpl", "Released under the GNU GPL v2."),
    ("gpl", "The emulator is licensed under GPL version 3 or any later version."),
    ("gpl", 'MODULE_LICENSE("GPL");'),
    ("gpl", " * SPDX-License-Identifier: GPL-2.0"),
    ("gpl", "This program is distributed under the terms of the GNU General Public License, either version 2 or version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either version 2.1"),
    ("lgpl", "License: LGPL-3.0"),
    ("lgpl", "The parser is covered by the GNU Lesser General Public License version 3."),
    ("lgpl", "Licensed under LGPLv2.1 or later."),
    ("agpl", "License: AGPL-3.0-or-later"),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    ("agpl", "The server is licensed under the GNU Affero General Public License v3.0."),
    ("agpl", "This project uses the AGPLv3 license."),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "BSD 3-Clause License\n\nCopyright (c) 2021, The Authors"),
    ("bsd", "License: BSD-3-Clause"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd", "The library is released under the simplified BSD license."),
    ("bsd", "Distributed under the new BSD license, see the file COPYING."),
    ("mpl", "Mozilla Public License Version 2.0"),
    ("mpl", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License)"),
    ("mpl", "License: MPL-2.0"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "ISC License"),
    ("isc", 'license: "ISC"'),
    ("isc", "This module is distributed under the ISC license."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("cc-by", "Text is available under CC BY-SA 4.0; additional terms may apply."),
    ("cc-by", "License: CC-BY-4.0"),
    ("cc-by", "Photos by the author, CC BY 2.0"),
    ("cc-by", "Content on this wiki is licensed under the Creative Commons Attribution 3.0 License"),
    ("cc-by-nc", "These lecture notes are licensed under CC BY-NC-SA 3.0."),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("cc-by-nc", "License: CC-BY-NC-4.0"),
    ("proprietary", "Copyright (C) 2018-2022 Acme Industries, Inc. All rights reserved."),
    ("proprietary", "(c) 2020 Globex. All Rights Reserved."),
    ("proprietary", "This document is proprietary and confidential. Unauthorized copying is prohibited."),
    ("proprietary", "Copyright 2015 John Doe"),
    ("mit", "Dual licensed under MIT and Apache 2.0"),
    ("gpl", "Licensed under the GNU General Public License v2 with the linking exception"),
    ("apache", "Package: foo\nLicense: Apache License 2.0\nVersion: 1.2"),
]

HARMLESS = [
    "She renewed her driving license last week.", "The bar lost its liquor license after the raid.", "A license to kill is a film of 1989.", "He holds a pilot's licence and flies on weekends.",
    "Copyright law protects authors for many years.", "The copyright office moved to a new building.", "They sued over copyright infringement and lost.", "Permission to land was refused by the tower.",
    "Smoking is prohibited in all rooms.", "He asked for permission to leave early.", "The permission was denied by the server with code 403.", "Redistribution of wealth was the topic of the debate.",
    "The MIT campus lies on the river.", "She studied physics at MIT before she moved to Bern.", "Researchers from MIT and Stanford published the results.", "The Apache are a people of the Southwest.",
    "Apache is a web server that many sites run.", "We installed Apache 2.4 on the new machine.", "The apache helicopter was shot down.", "BSD is a family of operating systems.",
    "FreeBSD 13 was released in April.", "The GNU project was started in 1983.", "The general public is invited to the opening.", "The lesser general public showed no interest in the matter.",
    "Mozilla published a new version of its browser.", "The commons is a place for creative people.", "Attribution of the painting is disputed.", "The author waived all rights to the film in 1994.",
    "All seats are reserved for members.", "We reserve the right to refuse service.", "Which license should I choose for my project?", "Is the GPL compatible with the Apache license?",
    "The GPL was written by Richard Stallman.", "Many companies avoid code under the AGPL.", "A comparison of the MIT and BSD licenses is given in chapter two.", "He wrote a book about free software licenses.",
    "The license server did not respond in time.", "Your trial license expires in 14 days.", "Enter your license key to continue.", "The software license costs 40 dollars a seat.",
    "The fishing licence is valid in two lakes.", "Marriage licenses are issued on Mondays.", "She is a licensed electrician.", "The licensed premises close at midnight.",
    "Licensing deals brought in two million.", "The town licensed three new taxis.", "An unlicensed driver caused the crash.", "The council voted to license street musicians.",
    "Copy the file and distribute it to your team.", "He was free to modify the plan and to pass it on.", "The terms of the contract were not published.", "See the file README for details of the build.",
    "Version 2.0 fixes several bugs.", "Version 3 was released on 29 June.", "The ISC meets every two years in Vienna.", "The CC line of the mail was empty.",
    "Please CC Maria on all mails.", "The party wants a new copyright directive.", "Under the new law, source code must be kept for ten years.", "The warranty is void if the seal is broken.",
    "His poetic license annoyed the historians.", "The number on the license plate was unreadable.", "We never licensed this to anyone.", "The question of who owns the copyright was left open.",
]
