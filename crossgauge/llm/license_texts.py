"""Whole licence texts as fixed values: digests of their canonical words, with and without title, appendix and https links.

Sources: the texts that Debian ships as common licences, and the texts of MIT, ISC, 0BSD, BSD and the Unlicense as
published; canonical words are license_scan.run_words (no copyright notices, no `all rights reserved`).
"""

#: (SPDX id, family, first words, words, characters, SHA-256 of the words with single blanks between).
TEXTS = (
    ("0BSD", "permissive", "bsd zero clause", 102, 614, "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153"),
    ("0BSD", "permissive", "permission to use", 98, 590, "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("0BSD", "permissive", "zero clause bsd", 101, 606, "53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe"),
    ("Apache-2.0", "permissive", "apache license version", 1426, 8838, "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "permissive", "apache license version", 1426, 8839, "65bfb6f56a10dc6dd6135cf4adeee0f5bc238b3d404067ac48dbf48c0ced3b32"),
    ("Apache-2.0", "permissive", "apache license version", 1431, 8866, "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Apache-2.0", "permissive", "apache license version", 1431, 8867, "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84"),
    ("Apache-2.0", "permissive", "apache license version", 1602, 9882, "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "permissive", "apache license version", 1602, 9884, "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("BSD-2-Clause", "permissive", "bsd 2 clause", 188, 1199, "f70e318812c2186c966e06dbe61de79ef179650c6b6b0763f3571effcefd5ab9"),
    ("BSD-2-Clause", "permissive", "bsd 2 clause", 188, 1213, "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9"),
    ("BSD-2-Clause", "permissive", "bsd 2 clause", 188, 1214, "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-2-Clause", "permissive", "bsd 2 clause", 190, 1217, "85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221"),
    ("BSD-2-Clause", "permissive", "bsd 2 clause", 190, 1218, "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "permissive", "redistribution and use", 184, 1178, "107f8ba0af742645bf7864695e36616fbcaa19b8c1ebb01f30fac7dd4011913a"),
    ("BSD-2-Clause", "permissive", "redistribution and use", 184, 1192, "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-2-Clause", "permissive", "redistribution and use", 184, 1193, "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "permissive", "redistribution and use", 186, 1196, "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374"),
    ("BSD-2-Clause", "permissive", "redistribution and use", 186, 1197, "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "permissive", "the bsd 2", 189, 1203, "80ad0421f0f534e8c876be108e2a472cb774f475ac18f2dd5de5f5777a632ddf"),
    ("BSD-2-Clause", "permissive", "the bsd 2", 189, 1217, "117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe"),
    ("BSD-2-Clause", "permissive", "the bsd 2", 189, 1218, "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9"),
    ("BSD-2-Clause", "permissive", "the bsd 2", 191, 1221, "239190ee903aca2851ccd5099cd7954d026d60f9b9f98e391ca652499c6aaae1"),
    ("BSD-2-Clause", "permissive", "the bsd 2", 191, 1222, "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b"),
    ("BSD-3-Clause", "permissive", "bsd 3 clause", 218, 1382, "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71"),
    ("BSD-3-Clause", "permissive", "bsd 3 clause", 218, 1400, "0fbd7c43c4bb3e398d262b8e39f58ee0a8709a2b3b6b4bee4e033b3d5755f58d"),
    ("BSD-3-Clause", "permissive", "bsd 3 clause", 218, 1401, "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("BSD-3-Clause", "permissive", "bsd 3 clause", 221, 1406, "94a0a44b170114affb7b3975c6987906dca819b6cbd93510aa70be57345a1e3f"),
    ("BSD-3-Clause", "permissive", "bsd 3 clause", 221, 1407, "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "permissive", "redistribution and use", 214, 1361, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "permissive", "redistribution and use", 214, 1379, "b6ab7953b6c80a72261014244324a70663f1807fa212f52461b24c95eb16b4a9"),
    ("BSD-3-Clause", "permissive", "redistribution and use", 214, 1380, "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", "permissive", "redistribution and use", 217, 1385, "cc3432eb2f19bb6fe96706bad75b6fce1039db64fb70486899bf6425dea4d9cb"),
    ("BSD-3-Clause", "permissive", "redistribution and use", 217, 1386, "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "permissive", "the bsd 3", 219, 1386, "1b9c2fc92ea32d1c705d689163d6e1783efd910af0262514c4185cad11fefe75"),
    ("BSD-3-Clause", "permissive", "the bsd 3", 219, 1404, "2197427e156dd704210ae726a3807f7deae35bc31d7243168c575348f6a5419b"),
    ("BSD-3-Clause", "permissive", "the bsd 3", 219, 1405, "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903"),
    ("BSD-3-Clause", "permissive", "the bsd 3", 222, 1410, "52c8e1f1387429e4ac2e46a159e2b2d17320de20b05dce03cbd7a7cf9be73702"),
    ("BSD-3-Clause", "permissive", "the bsd 3", 222, 1411, "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da"),
    ("CC0-1.0", "public-domain", "creative commons legal", 1088, 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "copyleft", "gnu free documentation", 3315, 19584, "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "copyleft", "gnu free documentation", 3731, 21997, "6f33c1fea6b4e2c3276ae8e374515f28815f379102edd5c8d33a05b42bed3883"),
    ("GPL-1.0", "copyleft", "gnu general public", 1637, 9388, "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-1.0", "copyleft", "gnu general public", 1642, 9416, "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-1.0", "copyleft", "gnu general public", 2056, 11703, "9caf042595280548f0149ac88169a7f2e04f35b2a642cf00b991f00d48bfa4ce"),
    ("GPL-2.0", "copyleft", "gnu general public", 2500, 14456, "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),
    ("GPL-2.0", "copyleft", "gnu general public", 2505, 14484, "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-2.0", "copyleft", "gnu general public", 2976, 17118, "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "copyleft", "gnu general public", 5226, 30889, "a37974b0e78a8c32321bdac900b0bfa998900cf83b67d2a365af05d6c14573b5"),
    ("GPL-3.0", "copyleft", "gnu general public", 5231, 30917, "15b5df1cc4fde465972f6b4e790713a04ab792461d0064a490fd856762946722"),
    ("GPL-3.0", "copyleft", "gnu general public", 5676, 33377, "d97853dcfd574d3364bf2e1f6975f4177eeafac2bef29ba9718b133e7a77653c"),
    ("ISC", "permissive", "isc license isc", 114, 692, "8281b7122b87e54b97a6183786fef9b33350db9bfb9141855ea93e09543e1fcc"),
    ("ISC", "permissive", "isc license isc", 115, 695, "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1"),
    ("ISC", "permissive", "isc license permission", 113, 688, "673f59dc8ad54524704b5b5d2deeb39eec917afad46597b1b7d4f2963edff317"),
    ("ISC", "permissive", "isc license permission", 114, 691, "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("ISC", "permissive", "permission to use", 111, 676, "280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29"),
    ("ISC", "permissive", "permission to use", 112, 679, "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "permissive", "the isc license", 114, 692, "8ee0d4f927294d5cfe44a2a4b1faecb347cc94d0e53edd910b1abc0f6527865f"),
    ("ISC", "permissive", "the isc license", 115, 695, "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("LGPL-2.0", "copyleft", "gnu library general", 3860, 22249, "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "copyleft", "gnu library general", 3865, 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "copyleft", "gnu library general", 4188, 24067, "289c8b47fa0ec7e5f22cd33d32feaa06f015b0f2fdb9ad916979b1011ca8c015"),
    ("LGPL-2.1", "copyleft", "gnu lesser general", 4060, 23337, "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "copyleft", "gnu lesser general", 4065, 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "copyleft", "gnu lesser general", 4389, 25154, "5ddd6039d3b090c51328879800301dd19b1ad99e14d00f3c6f221ab45a32db57"),
    ("LGPL-3.0", "copyleft", "gnu lesser general", 1251, 7294, "af4f466bab5554afad60c219ff8bf29eddb00df6ef0f1fcf73fa05ad4b3289f5"),
    ("MIT", "permissive", "mit license permission", 165, 1000, "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", "permissive", "permission is hereby", 163, 988, "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", "permissive", "the mit license", 166, 1004, "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", "permissive", "the mit license", 167, 1008, "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MPL-1.1", "copyleft", "mozilla public license", 3786, 22448, "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "copyleft", "mozilla public license", 2426, 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-2.0", "copyleft", "mozilla public license", 2426, 14342, "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("Unlicense", "public-domain", "this is free", 200, 1171, "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
    ("Unlicense", "public-domain", "this is free", 200, 1172, "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff"),
)
