"""Digests (licenses.digest) of long licence texts and of the first paragraphs of their standard headers, made from the texts as published."""

#: licence identifier, digest
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "7816c740d40ff86e44ae63880e754beda2f7b1a85029c4ce9db73bc3f521706d"),  # whole text
    ("Apache-2.0", "94bb0745f717f872879253b4c5fbcdbcda3f35695ca19a5e7216bca272d94a56"),  # whole text, without what follows its terms
    ("Apache-2.0", "d877c65756ca456289463f8ae19d68409cda80fd67e387fad03a64b3235fde6a"),  # whole text, without its last line and what follows
    ("Apache-2.0", "05369519785beeae50e8b52537bf3155eda6b7459224dbfc24e32a66bd6cc6cc"),  # standard header, first paragraph
    ("CC0-1.0", "c8d5c37335f9acd73b0fcc57a0c391456b07dbd58bf37c077940cf3b4f2619dd"),  # whole text
    ("GFDL-1.2-only", "8e6c3061f7082f9e3c96129cdbc9210edfb81a456bad5a514c171ff6f32ccb96"),  # whole text
    ("GFDL-1.3-only", "695a5ca2420190829ff0dddc2b90d6fb66f7d8a6f76a0e22b4c1996999ab79e3"),  # whole text
    ("GPL-1.0-only", "793acdd7764d3a9cf7fca7d67b6d821f71ddd952351df680fb12f2aac5345e17"),  # whole text
    ("GPL-1.0-only", "fee3da535e7e44b853633e5707ed7769a39881ad8247e284e579865f9406fa7e"),  # whole text, without what follows its terms
    ("GPL-1.0-only", "93825e6cefd3ddb1928b5fbed6f50bad156fc9e398e6b40bca68e36a8ee6696a"),  # whole text, without its last line and what follows
    ("GPL-1.0-or-later", "28392950b1f6524ecf99d845a5f3f51fd98c5351e3093f90911c56291c9b74cd"),  # standard header, first paragraph
    ("GPL-2.0-only", "dea7259971358bdaeb4bbd8061c252c14a2aa58876ee09e07c356e44ea7b6ade"),  # whole text
    ("GPL-2.0-only", "da84da5745574f56d2d0a5d3449ce863f3ae3684aa3783c76ee33aa029e8530c"),  # whole text, without what follows its terms
    ("GPL-2.0-only", "5ced2d6f0b695a79eaefbe8cb3bb13393668a19d6efece61f659227fad25722f"),  # whole text, without its last line and what follows
    ("GPL-2.0-or-later", "510421d7e6606ce4c646291251f3e5716837ca4502f478fba305e73145d4e6f7"),  # standard header, first paragraph
    ("GPL-3.0-only", "41183e6c35b944f215ec1f34d6149037021fa29deb319b7093633eb90c6ce40a"),  # whole text
    ("GPL-3.0-only", "944f75b68acb22550433090b4c38ba4cd43c2c5f06fde8833619c12426afbf7f"),  # whole text, without what follows its terms
    ("GPL-3.0-only", "018503bd54da4d77aef8852d91699f4c6492dc476437b0cd4ec1fb63ec816f02"),  # whole text, without its last line and what follows
    ("GPL-3.0-or-later", "ef4f0bb1025d51a56473afb9d8eb9679d550fbaae920f20c3d68a20d256229cb"),  # standard header, first paragraph
    ("LGPL-2.0-only", "2f7bc1b21748452721f18b009140bcea434e1576f005ace39469bd1bcbe89a38"),  # whole text
    ("LGPL-2.0-only", "8baa622925ec678570740e49ad1adc3fa9a07e6041b7204b71b8261f377619bc"),  # whole text, without what follows its terms
    ("LGPL-2.0-only", "e85c2f76078d521b89498ad6ee5b412f7d91f4fa0582027869cf8be9ca4cfd14"),  # whole text, without its last line and what follows
    ("LGPL-2.0-or-later", "c43dfbfc98e82261cca55e0f23ef1f050e26d0c829a70e80ef1e1d02c19576cc"),  # standard header, first paragraph
    ("LGPL-2.1-only", "546515100863721407e90d4b65a562c00b9f9299dfe45bb3d73152dbef1f594f"),  # whole text
    ("LGPL-2.1-only", "fcabfdab9912d26c7ebd5d3cca1e9cdc2c5a438b041875dde9cd7740518c9b25"),  # whole text, without what follows its terms
    ("LGPL-2.1-only", "b9e0ba96d19ace524bdf1f9c8fb13316eba21ab9755643ad6cf323eca66f64b6"),  # whole text, without its last line and what follows
    ("LGPL-2.1-or-later", "3d43f3599cd8306a5e9c7255077f3c826a7543312eda4ecf9d50975abeb8e95f"),  # standard header, first paragraph
    ("LGPL-3.0-only", "ab489a2b3c40a7a5f664f8ba83cd43648b21d24154200b7d80fda85d59624a2c"),  # whole text
    ("MPL-1.1", "72b015a8eeb59f79bcc2e54084d3d8a61fa4671a0ca883c7c66d6dbb1359cc05"),  # whole text
    ("MPL-2.0", "2c94dead4389f371d398584d16dfa47a1d1e1d157f66809df456ccfa986befd4"),  # whole text
    ("MPL-2.0", "acb0bece3dc447740b87a4db23e0d425157552e4a33f273241a94444c2368900"),  # standard header, first paragraph
]
