"""Fixed lists: addresses of known incidents, the baseline of frozen addresses, known contracts, names of types.

The values are data that the operators read; they stand as they are given, a malformed address among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilspark import schemas

# Address, chain, incident, estimated loss in USD, date, who named it.
INCIDENTS = (
    ("0x47666fab8bd0ac7003bce3f5c3585383f09486e2", "ETH", "Bybit Hack Feb 2025", 1_400_000_000, "2025-02-21", "ZachXBT / FBI"),
    ("0xa4b2b3fcd8b63f2e45109503391afc6db0e150fa", "ETH", "Bybit Hack Feb 2025", 1_400_000_000, "2025-02-21", "ZachXBT"),
    ("0x3d487a30e4fce5e0455601baa96025f498a19148", "ETH", "Bybit Hack Feb 2025", 1_400_000_000, "2025-02-21", "Elliptic"),
    ("0xdd90071d52ee5a3e1c3487df534e37fe29851878", "ETH", "Bybit Hack Feb 2025", 1_400_000_000, "2025-02-21", "Elliptic"),
    ("0xefd8a24dc25b8cf0a44f9462a0b3e29db592cebe", "ETH", "Bybit Hack Feb 2025", 1_400_000_000, "2025-02-21", "FBI"),
    ("0x098b716b8aaf21512996dc57eb0615e2383e2f96", "ETH", "Ronin Bridge Hack 2022", 625_000_000, "2022-03-23", "FBI / OFAC"),
    ("0x4f3a120e72c76c22ae802d129f599bfdbc31cb81", "ETH", "Ronin Bridge Hack 2022", 625_000_000, "2022-03-23", "Chainalysis"),
    ("0x56d8b635a7c88fd1104d23d632af40c1c3aac4e3", "ETH", "Nomad Bridge Hack 2022", 190_000_000, "2022-08-01", "Chainalysis"),
    ("0xb5c55f76f90cc528b2609109ca14d8d84b9df1cf", "ETH", "Nomad Bridge Hack 2022", 190_000_000, "2022-08-01", "PeckShield"),
    ("0x0d043128146654c7683fbf30ac98d7b2285ded00", "ETH", "Harmony Horizon Bridge 2022", 100_000_000, "2022-06-23", "FBI"),
    ("0x9e91ae672e7f7330fc6b8c2b96cc36509e55e3b4", "ETH", "Harmony Horizon Bridge 2022", 100_000_000, "2022-06-23", "Elliptic"),
    ("0xeb31973e0febf3e3d7058234a5ebbae1ab4b8c23", "ETH", "KuCoin Hack 2020", 281_000_000, "2020-09-26", "Chainalysis"),
    ("0x735d5c91d36f4ff9f3d20b47c8af4c7a200d4ddf", "ETH", "KuCoin Hack 2020", 281_000_000, "2020-09-26", "SlowMist"),
    ("0x30956e2fdbf5d5d9e16fce1b4b0e62c0fcbe1ea5", "ETH", "Atomic Wallet Hack 2023", 100_000_000, "2023-06-03", "Elliptic"),
    ("0x3130662aeac0e1a2a0a0b9e8d3b57f30e tried6f", "ETH", "Stake.com Hack 2023", 41_000_000, "2023-09-04", "FBI"),
    ("0x04b21735e93fa3f36b6e1e3413468ae60b6b0002", "ETH", "WazirX Hack 2024", 230_000_000, "2024-07-18", "ZachXBT"),
    ("bc1qnxpnk40mq7s93uaem8yxmffjj0dwvv9ra6n7p", "BTC", "Lazarus Group BTC", 0, "2024-01-01", "OFAC"),
    ("3HMHpWQPRGCCg1VGwreiSjEtaqLW8kNbMF", "BTC", "Lazarus Group BTC", 0, "2022-04-14", "OFAC"),
    ("0x905b63fff465b9ffbf41dea908ceb12de60340e5", "ETH", "Tornado Cash", 0, "2022-08-08", "OFAC"),
    ("0x53b6936513e738f44fb50d2b9476730c0ab3bfc1", "ETH", "Lazarus Group Cluster", 0, "2023-01-01", "Elliptic"),
    ("0x0583a9d956e0be22c2fea0e39bf263e3d1e72701", "ETH", "Lazarus Group Cluster", 0, "2023-01-01", "Chainalysis"),
)

# Frozen addresses known before any feed is read.
FROZEN = (
    ("0xefbaaf73fc22f70785515c1e2be3d5ba2fb8e9b0", "ETH"),
    ("0x1da5821544e25c636c1417ba96ade4cf6d2f9b5a", "ETH"),
    ("0x7db418b5d567a4e0e8c59ad71be1fce48f3e6107", "ETH"),
    ("0x72a5843cc08275c8171e582972aa4fda8c397b2a", "ETH"),
    ("0x7f367cc41522ce07553e823bf3be79a889dede1b", "ETH"),
    ("0x7ff9cfad3877f21d41da833eb7f3c97c4dc108c0", "ETH"),
    ("0xd882cfc20f52f2599d84b8e8d58c7fb62cfe344b", "ETH"),
    ("0x901bb9583b24d97e995513c6778dc6888ab6870e", "ETH"),
    ("0xa7e5d5a720f06526557c513402f2e6b5fa20b008", "ETH"),
    ("0x8576acc5c05d6ce88f4e49bf65bdf0c62f91353c", "ETH"),
    ("0xc455f7fd3e0e12afd51fba5c106909934d8a0e4a", "ETH"),
    ("0xfec8a60023265364d066a1212fde3930f6ae9d65", "ETH"),
    ("0x308ed4b7b49797e1a98d3818bff6fe5385410370", "ETH"),
    ("0x67d40ee1a85bf4a4bb7ffae16de985e8427b6b45", "ETH"),
    ("0x6acdfba02d390b97ac2b2d42a63e85293bcc160e", "ETH"),
    ("0x6f1ca141a28907f78ebaa64fb83a9088b02a8352", "ETH"),
    ("0xfae0c6cfce04e3b2ec2de088bce4ef978feb4047", "ETH"),
)

# Known contracts: address, category, product, name, role.
CONTRACTS = (
    ("thor15xwa4y4wucma9gmcakjjg7mw36skpuhenhwlh9nkjn8vjguz6xzs8nc8np", "AutoRujira", "AutoRujira", "Auto workflow manager", "Workflow manager"),
    ("thor136rwqvwy3flttm9wfnc5xgnlr6mu5k8e2elgzs2hdhuwf50w3l2q0nu2qu", "CALC", "Recurring Swaps", "CALC Manager", "Workflow manager"),
    ("thor1lhpghazamcsr67y4ehah8pxwyn0s4klyz2qsm8v7wkqylffaja3qrwlct0", "CALC", "Recurring Swaps", "Recurring Swaps", "Strategy executor"),
    ("thor1t2cnyn98xusxakgemsenn2p9n3ykd6accr2c0zg22nczh097ln7qeze20f", "CALC", "Recurring Swaps", "CALC Scheduler", "Workflow scheduler"),
    ("thor1r9wq0ehkef0l27tel9qw8hke2fsqktpxg66rnls32xffypf2htrs6peq6z", "Levana Perps", "Levana Perps", "Levana Perps Market - ATOM_USDC", "market"),
    ("thor1v86dpn86jcftmr6xwmg9ure4fhdxta9n2eup5ag8udw3h7uvmrusqj8whg", "Levana Perps", "Levana Perps", "Levana Perps Market - AVAX_USDC", "market"),
    ("thor1gflccmghzfscmxl95z43v36y0rle8v9x8kvt9na03yzywtw86amsjnq5h2", "Levana Perps", "Levana Perps", "Levana Perps Market - BCH_USDC", "market"),
    ("thor17e5wqwfd6pjm7cdg54vg5xf255gssckgtltew46w50pptk2he92smq4r35", "Levana Perps", "Levana Perps", "Levana Perps Market - BNB_USDC", "market"),
    ("thor1cyd63pk2wuvjkqmhlvp9884z4h89rqtn8w8xgz9m28hjd2kzj2cqwugjkp", "Levana Perps", "Levana Perps", "Levana Perps Market - BTC_USDC", "market"),
    ("thor1cgjnhuf86dnwc6gs8p78x0nmexzht8gpzy9gpv9xh8g03f94vu0q3dpdq2", "Levana Perps", "Levana Perps", "Levana Perps Market - DOGE_USDC", "market"),
    ("thor1wastjc07zuuy46mzzl3egz4uzy6fs59752grxqvz8zlsqccpv2wqjtw9mm", "Levana Perps", "Levana Perps", "Levana Perps Market - ETH_USDC", "market"),
    ("thor1zmgfjea6e4p94n07j6982yhmhhg5yev33u3v8vwdjkkaa0748ljqypzf9r", "Levana Perps", "Levana Perps", "Levana Perps Market - LTC_USDC", "market"),
    ("thor19egn9e8v5493mtum626upcjyu5xj3mru57htge0ma66sk5gyqf4qac33sr", "Levana Perps", "Levana Perps", "Levana Perps Market - RUNE_USDC", "market"),
    ("thor105espjya6qc7tazk8drsnvf2675q5wywafnwlhs5tpx9yza7hpmqpynjwv", "Levana Perps", "Levana Perps", "Levana Perps Market - XRP_USDC", "market"),
    ("thor1gclfrvam6a33yhpw3ut3arajyqs06esdvt9pfvluzwsslap9p6uqt4rzxs", "Levana Perps", "Levana Perps", "Levana Perps factory", "factory"),
    ("thor1v3f7h384r8hw6r3dtcgfq6d5fq842u6cjzeuu8nr0cp93j7zfxyquyrfl8", "RUJI Index", "RUJI Index", "RUJI Index affiliate", "affiliate"),
    ("thor1q9q732ell3urxvlcx24s8zrqr6g5s9ymnh9844auvqcp3qwpsjeqqpgxxz", "RUJI Index", "RUJI Index", "RUJI Index entry adapter", "adapter"),
    ("thor1yqf5spdv8c4088zmvqsg32eq63fzepsjvntahdk0ek0yjnkt3qdqftp3lc", "RUJI Index", "RUJI Index", "RJI - The Rujira Index", "Fixed index"),
    ("thor1mlphkryw5g54yfkrp6xpqzlpv4f8wh6hyw27yyg4z2els8a9gxpqhfhekt", "RUJI Index", "RUJI Index", "yRUNE - The Yield Bearing RUNE Index", "NAV index"),
    ("thor1h0hr0rm3dawkedh44hlrmgvya6plsryehcr46yda2vj0wfwgq5xqrs86px", "RUJI Index", "RUJI Index", "yTCY - The Yield Bearing TCY Index", "NAV index"),
    ("thor1s8rxcvg83cwar87ehv4c866auxujkfj3k4wjkxkaren7vmvn9nass80ekp", "RUJI Trade", "RUJI Trade", "RUJI Trade ATOM-USDC", "Trading pair"),
    ("thor15t4cykf3mj8fsvd6ha8j0lnavcyex2h4a4l2pv8zkctandwck3zshs92jy", "RUJI Trade", "RUJI Trade", "RUJI Trade AUTO-USDC", "Trading pair"),
    ("thor1dw8tadkwy746ytvaugv26g5jwekwpfyjyvlvncvryukm07rc998s4ukvrt", "RUJI Trade", "RUJI Trade", "RUJI Trade AVAX-USDC", "Trading pair"),
    ("thor1s4jpxtz0jsh6elyqcdujd303ptefz53gknmcp437rm9ykxnfhysqrm5hze", "RUJI Trade", "RUJI Trade", "RUJI Trade BCH-USDC", "Trading pair"),
    ("thor1g49m6re9vgrte8twpgx0qcnvr92575tqhcgmnwq3g5s94msk4ersqsyw3x", "RUJI Trade", "RUJI Trade", "RUJI Trade BNB-USDC", "Trading pair"),
    ("thor1vk6trmz42cjrh4zcxczeaacnsv3snv4f22x8ccu203dqde7vtaxsyevlec", "RUJI Trade", "RUJI Trade", "RUJI Trade bRUNE-RUNE", "Trading pair"),
    ("thor1dwsnlqw3lfhamc5dz3r57hlsppx3a2n2d7kppccxfdhfazjh06rs5077sz", "RUJI Trade", "RUJI Trade", "RUJI Trade BTC-USDC", "Trading pair"),
    ("thor1sttnfysg5e92d82gu9vg7jl9dhu29h4w8mujg7hsfdy3qj6ryuwsaqwu5m", "RUJI Trade", "RUJI Trade", "RUJI Trade BTC-USDT", "Trading pair"),
    ("thor1ar3grsxufvmr3fq8j92ssvc8vcyzdkhh9rlg5mdmuw8we552htxsf4mct2", "RUJI Trade", "RUJI Trade", "RUJI Trade cbBTC.BASE-BTC", "Trading pair"),
    ("thor1qa2l2rrzjq30j2wphc3hcz3ykjz8aaqcjlrnzmp00hy0cpk233ysm9rr3c", "RUJI Trade", "RUJI Trade", "RUJI Trade DAI-USDC", "Trading pair"),
    ("thor1w8agselh7k2e4ty369v39lngkckljxfafm35d06f7wj3ar90h2esv75t7p", "RUJI Trade", "RUJI Trade", "RUJI Trade DOGE-USDC", "Trading pair"),
    ("thor1624v08rr5na2hv5jazw5tmyyjyqg8lfy78zvck52ep3nqxa7lljq00e4xq", "RUJI Trade", "RUJI Trade", "RUJI Trade ETH.BASE-ETH", "Trading pair"),
    ("thor1g3mymxjlmvyeadfys6lsj98sgg7mxut5pwz99q5rat7ny698elwq778ngf", "RUJI Trade", "RUJI Trade", "RUJI Trade ETH-BTC", "Trading pair"),
    ("thor1tnd06uswj8033d0kzd5d7zre73u3uc44r2vvez26z5m4kr68vtusf2snva", "RUJI Trade", "RUJI Trade", "RUJI Trade ETH-USDC", "Trading pair"),
    ("thor1fekmqh9crnzdaudrsqxk5gmwcch6xrfre288nqmx4hpk8sscw6hq9kkxn6", "RUJI Trade", "RUJI Trade", "RUJI Trade ETH-USDT", "Trading pair"),
    ("thor19pdw7vjkhk0qhvn7r3xgj6f5zyyj700w6my3z28cv9ugzu7gp5rqv5596l", "RUJI Trade", "RUJI Trade", "RUJI Trade GUSD-USDC", "Trading pair"),
    ("thor1t76lvqjq7avt6kxnul4pt0zaq6y06fhkw29wxs5rm4kt873s6y9sdp8rxf", "RUJI Trade", "RUJI Trade", "RUJI Trade LQDY-BTC", "Trading pair"),
    ("thor1ax94w4rldvdgc4xgsfwgve7g7xfyxhvuvquvx57vtmr6y4alev0qw3mlvr", "RUJI Trade", "RUJI Trade", "RUJI Trade LQDY-USDC", "Trading pair"),
    ("thor1ks9qq0nwv7qxtnznesys6ylflwruqlf85er6zls4erwgzkvw0m0qs3rghz", "RUJI Trade", "RUJI Trade", "RUJI Trade LTC-USDC", "Trading pair"),
    ("thor1txmrchsrzycmzvlwsjl20q9zkdsp0nywctefuceepf02phpudvxsxtzmty", "RUJI Trade", "RUJI Trade", "RUJI Trade NAMI-USDC", "Trading pair"),
    ("thor1j9euq8fjd5zdxdkx7auser7kp84tmwtx3snuptpec6azakzwv3dqq6ahwp", "RUJI Trade", "RUJI Trade", "RUJI Trade RUJI-RUNE", "Trading pair"),
    ("thor17cawwg2lsnvcne69fek6nsqkf8snma6gc5ccceshul86rl0u3q4s5l5d0a", "RUJI Trade", "RUJI Trade", "RUJI Trade RUJI-USDC", "Trading pair"),
    ("thor1qqql3tugjuwnslfgf9a9zfqenywn2h8zy9v025vh3398xtzpaqcsx5axyl", "RUJI Trade", "RUJI Trade", "RUJI Trade RUNE-BTC", "Trading pair"),
    ("thor1y8g3yhzmnwyt6g7jque36eyregf85kgtzem6dgzqxuzrpmzpumvqts7ud7", "RUJI Trade", "RUJI Trade", "RUJI Trade RUNE-USDC", "Trading pair"),
    ("thor1jshw3secvxhzfyza6aj530hrc73zave42zgs525n0xkc3e9d6wkqrm8j3y", "RUJI Trade", "RUJI Trade", "RUJI Trade TCY-BTC", "Trading pair"),
    ("thor12ds7fxj5g47jwzfzvzzhzxxd3cp6v55flgwxva0803r8k5mzm44skth6wa", "RUJI Trade", "RUJI Trade", "RUJI Trade TCY-RUNE", "Trading pair"),
    ("thor1kyjky2yprmamj0gfkevyc6tunxev0054gpxjap8k9vkyutkkf5lqyr0xxv", "RUJI Trade", "RUJI Trade", "RUJI Trade TCY-USDC", "Trading pair"),
    ("thor14sk3vqzt6rpp8c06ynfhw30ctk0wy5mqhvedccg8gnnlcdcyc9csaf4ngt", "RUJI Trade", "RUJI Trade", "RUJI Trade USDC.AVAX-USDC", "Trading pair"),
    ("thor1kkuhwaqnlnvchx6fzttp7l9vhman9ll9u6dyhx65v4c7gcpflvcqkdv7z9", "RUJI Trade", "RUJI Trade", "RUJI Trade USDC.BASE-USDC", "Trading pair"),
    ("thor1f9zc2sdua4n6nreuxzhed9435n0cf6v6lpx6nrjdadtkr294a26qhs676n", "RUJI Trade", "RUJI Trade", "RUJI Trade USDC.BSC-USDC", "Trading pair"),
    ("thor1zj84djje5t0cn3veezmlfewmzmn6yn793nkrtfkjhcywdyyca9tq9582yf", "RUJI Trade", "RUJI Trade", "RUJI Trade USDP-USDC", "Trading pair"),
    ("thor1mj73004rhycffu6k56dalt0zmefzdc3ana6egkh4aes9aw43lxqqmfq2xg", "RUJI Trade", "RUJI Trade", "RUJI Trade USDT.AVAX-USDC", "Trading pair"),
    ("thor1mgjtf976cnurac63yh2tldmw2mme5f4a8n0u7m3d5yvxk6x5yrws4u37es", "RUJI Trade", "RUJI Trade", "RUJI Trade USDT.BSC-USDC", "Trading pair"),
    ("thor14qg8r6u7x4yt57565ztm6v8fwkd2t0j8wqnx6k872yt49ynx8d0q6s7kq0", "RUJI Trade", "RUJI Trade", "RUJI Trade USDT-USDC", "Trading pair"),
    ("thor1e5dmfdtpveprsznzyqjdygy2fd782d0q9zm7246e7jhvmq04nqnqm78vek", "RUJI Trade", "RUJI Trade", "RUJI Trade wBTC-BTC", "Trading pair"),
    ("thor14v89h32ztmfg9d230cjly7ac26fvdkhgq7nkntsw4uy2f3yh2v7qrz6hsw", "RUJI Trade", "RUJI Trade", "RUJI Trade XRP-USDC", "Trading pair"),
    ("thor1ekkt8wfls055t7f7yznj07j0s4mtndkq546swutzv2de7sfcxptq27duyt", "RUJI Money Market", "RUJI Money Market", "RUJI Credit Account", "Credit"),
    ("thor1wl05yf4keucptp9m69yzenafmn674r9jcwfwdufar75hq9hcmu9sk66g8w", "RUJI Money Market", "RUJI Money Market", "Lending vault: ATOM", "Lending vault"),
    ("thor13etu2zrdqlh69j87dd5dlnfpwa6cuhzlphm7jhj097uvue7mpc5s8y7xal", "RUJI Money Market", "RUJI Money Market", "Lending vault: AVAX", "Lending vault"),
    ("thor1km2sgadhmev34v40evf8qh2yw77hxecakn9nu0g35zdtsf905ehqhqk76r", "RUJI Money Market", "RUJI Money Market", "Lending vault: BCH", "Lending vault"),
    ("thor1r6c37cu0twdkgp9df3z0kkscdwakqmvvkfzvkf2kl0glr7klkzas9e4fld", "RUJI Money Market", "RUJI Money Market", "Lending vault: BNB", "Lending vault"),
    ("thor18e6gxcvmqfn06l09gurgwh3urlj9xztqagaslgspl2l74ejuujnqqlzzun", "RUJI Money Market", "RUJI Money Market", "Lending vault: BTC", "Lending vault"),
    ("thor1ycnr44val8v9rexn0qa06m920gr4rrrnldkcnf3pah5nr0lkdsxsnxnwsm", "RUJI Money Market", "RUJI Money Market", "Lending vault: cbBTC.BASE", "Lending vault"),
    ("thor1pkuuapnanzxseywxgp2dmd39p2ysgws2gq9dzs2kw680ed7x58rq03fs9a", "RUJI Money Market", "RUJI Money Market", "Lending vault: DAI", "Lending vault"),
    ("thor1drfu6vrn06gam7fdk07xqmavthgy6rnmnmm2mh4fa047qsny52aqvxuck9", "RUJI Money Market", "RUJI Money Market", "Lending vault: DOGE", "Lending vault"),
    ("thor1xufzny7n3565jy3rvglacengpn6eufw7lk5y9h4zxludkfe96q4s9j5uln", "RUJI Money Market", "RUJI Money Market", "Lending vault: ETH", "Lending vault"),
    ("thor1yskkyzurah4yxj49udkgacpfj0mkyfmm23al5rmng7nuktd3vpusv8r66h", "RUJI Money Market", "RUJI Money Market", "Lending vault: ETH.BASE", "Lending vault"),
    ("thor1u6razughlrjdu99ku3n803fq0pj5upnut2axj0kxpeaanch9kh7qfprdsn", "RUJI Money Market", "RUJI Money Market", "Lending vault: GUSD", "Lending vault"),
    ("thor1633kq6mxwn24ezdn38xpngksx8wlu458yesdqf3xhs2cfaan96cs2c3gdz", "RUJI Money Market", "RUJI Money Market", "Lending vault: LTC", "Lending vault"),
    ("thor12xadusl39ad4ru8j333pgylav2lqkgldf0l2etx6wv9u5npzm3as4l5nxx", "RUJI Money Market", "RUJI Money Market", "Lending vault: RUNE", "Lending vault"),
    ("thor19l9tl8h6nkf5ea4qaxqht6qzgrh5nnh3sng588plke7n72swhn4s5lpyru", "RUJI Money Market", "RUJI Money Market", "Lending vault: USDC.BASE", "Lending vault"),
    ("thor1jj7nt72ne7mvtsfvp9rze6w4d8pz69cr5s04602gestqpleamweqw8wm6y", "RUJI Money Market", "RUJI Money Market", "Lending vault: USDP", "Lending vault"),
    ("thor1smdzjdm5q5e5kf6farvcgmxe44uhga2ety68veu2nupf5dzx55xsn3u4rj", "RUJI Money Market", "RUJI Money Market", "Lending vault: USDT", "Lending vault"),
    ("thor1es23h3sdeytdhntaa88xl3fndj3vahpzm3d0xe8f2vf80d8kygwqlm7zux", "RUJI Money Market", "RUJI Money Market", "Lending vault: USDT.BSC", "Lending vault"),
    ("thor1374grrwf8fndz2glcas7vt6y0fa5vw4lxgh7ay9wm4kc5cjymygsatfs6k", "RUJI Money Market", "RUJI Money Market", "Lending vault: WBTC", "Lending vault"),
    ("thor1cvry7e7uzd89dv4hls5rg5m4xykczzu2qvj8dq5e93c75566tk9q7cya3l", "RUJI Money Market", "RUJI Money Market", "Lending vault: XRP", "Lending vault"),
    ("thor1mcy9jtp4kzl8q2lvdgfgsl8jvqrf504uphkf0pz2p9wud8tsntesjvccew", "Utilities", "Revenue collector", "Revenue Converter #1: Single", "Revenue collector"),
    ("thor1gm8q2gr25nzzsxzdp2mpja4hyvyhjlr4s6krcsgv2y953uu0js3qhwpus7", "Utilities", "Revenue collector", "Revenue Converter #2: RUJI Trade", "Revenue collector"),
    ("thor1jduxxzpyyvrgzx7zcnl7e5cdj34tnq5jxy00a4wp86szye25dndq575c0y", "Utilities", "Revenue collector", "Revenue Converter #3: Split", "Revenue collector"),
    ("thor1txum04wp8ykqudphxy9prtwsd9jpcm2kwdaxctxeeyr6g0r0we9qpfdktr", "Utilities", "Revenue collector", "Revenue Converter #4: Base Layer", "Revenue collector"),
    ("thor132u9qpm9gfdqtgwxwl8ty409s6zmewfrum2k6wvtvtyphdn5urzsej764l", "Utilities", "Revenue collector", "Revenue Converter #5: NAMI Index", "Revenue collector"),
    ("thor179fex2rxd45caedmz4hxsnu42sw20lu0djyh4yukyh965sq8muuqptru2g", "Utilities", "Staking", "bRUNE Staking", "Staking"),
    ("thor18kxeqhw8nukm3sksj56uh4zf76ctn0mm3x8yrzr56hdhlsk966dqqeedwx", "Utilities", "Staking", "NAMI Staking", "Staking"),
    ("thor13g83nn5ef4qzqeafp0508dnvkvm0zqr3sj7eefcn5umu65gqluusrml5cr", "Utilities", "Staking", "RUJI Staking", "Staking"),
    ("thor1z7ejlk5wk2pxh9nfwjzkkdnrq4p2f5rjcpudltv0gh282dwfz6nq9g2cr0", "Utilities", "Staking", "TCY autocompounder (AutoRujira)", "Staking"),
    ("thor1n5a08r0zvmqca39ka2tgwlkjy9ugalutk7fjpzptfppqcccnat2ska5t4g", "AMM strategy", "Virtualisation Strategy", "Virtualisation Strategy", "AMM strategy"),
    ("thor1f88gayqapexm5ywmdn85c2s62h84j7gjhg8582ctxyew42n308pqqyg7js", "AMM strategy", "XYK Pool", "XYK Pool: ETH/USDC", "AMM strategy"),
    ("thor1g97844v7wuvz58m6p3vqp3u28nxaglqsag4dte2wrrry7sge9llq0t5tav", "AMM strategy", "XYK Pool", "XYK Pool: BTC/USDC", "AMM strategy"),
    ("thor1z6drgxf8js4mycfqfgqr3v4paep4p5ur7ff0suehyg0a6alm8uks29zyv0", "AMM strategy", "XYK Pool", "XYK Pool: RUJI/USDC", "AMM strategy"),
    ("thor1nwpkxz6ww2q6dz8ulkt804z8azm57s8lrrn67usrhpqxjt6sakeq24rf09", "AMM strategy", "XYK Pool", "XYK Pool: ETH/BTC", "AMM strategy"),
    ("thor185dc632j6nv0apdcg5lq7uppast0nmd4awkgzcfcq7phx65w3mjq0mmwqh", "AMM strategy", "XYK Pool", "XYK Pool: AUTO/USDC", "AMM strategy"),
    ("thor1c020ygq35hu6fp2hpd3ws0fa9xmlqhpw9g4nz624wnwmvlq7l49s877kkx", "AMM strategy", "XYK Pool", "XYK Pool: LQDY/USDC", "AMM strategy"),
    ("thor1lpupl5c5yfa2shd0uk3t0clahsv237zz8a7nvrdrktrjrxwgz56s80kew4", "AMM strategy", "XYK Pool", "XYK Pool: LQDY/BTC", "AMM strategy"),
    ("thor122f5ezcpnucazcjslwy4gg4q663lrn8xd0sum75ggv83v77tegpqclzq0v", "AMM strategy", "XYK Pool", "XYK Pool: BNB/USDC", "AMM strategy"),
    ("thor1qk2g3e6pg0rcsa0w9079zvczlldjufulp5an8gs5qdqym297jv5qxm73rr", "AMM strategy", "XYK Pool", "XYK Pool: BCH/USDC", "AMM strategy"),
    ("thor1s5g0rm6fk2cpcxmsy3zgft725azrxsmuxxrjzrgxzfe298g2m7uqt2ejw6", "AMM strategy", "XYK Pool", "XYK Pool: DOGE/USDC", "AMM strategy"),
    ("thor1rw9awvqnl6n0slk6tl9pw6nan77kum5480r93stc6unzlaneh6wqzrw0za", "AMM strategy", "XYK Pool", "XYK Pool: LTC/USDC", "AMM strategy"),
    ("thor19e8l7xkkkce0k5cjcz65ae9ntvjqft9cxcq2qn0tdtsc7339lv2szdqfhh", "AMM strategy", "XYK Pool", "XYK Pool: ATOM/USDC", "AMM strategy"),
    ("thor1vjxfh0smv78zchf0jcdz2wfv80nuhe2lcfr3dewde9p6khh4g7hq6sgtjw", "AMM strategy", "XYK Pool", "XYK Pool: AVAX/USDC", "AMM strategy"),
    ("thor193ec9vn36q9752ut6ntqpt94yfdcwxt4u47fmsv9ql4n7fkac38qucqckc", "AMM strategy", "XYK Pool", "XYK Pool: XRP/USDC", "AMM strategy"),
    ("thor1j45s6a4ym8ru2zd70acnrwk4fkmew2a43eq2wngu46ur7yg4d8eqnvvfxx", "AMM strategy", "XYK Pool", "XYK Pool: NAMI/USDC", "AMM strategy"),
)

# Display names of transaction types.
TYPE_LABELS = {
    "swap": "Swap", "addLiquidity": "Add LP", "withdraw": "Withdraw", "send": "Send", "refund": "Refund", "switch": "Switch", "contract": "Contract", "donate": "Donate", "fin-trade": "Trade",
    "fin-arb": "Arb", "fin-order": "Limit Order", "fin-order-wd": "Claim Order", "fin-order-inc": "Increase Order", "fin-order-dec": "Cancel Order", "fin-mm-fee": "MM Fee",
    "fin-range": "Range Create", "fin-range-dep": "Range Deposit", "fin-range-wd": "Range Withdraw", "fin-range-claim": "Range Claim", "fin-range-close": "Range Close",
    "fin-range-xfer": "Range Transfer", "fin-range-fee": "Range Fee", "bow-swap": "AMM Swap", "bow-deposit": "AMM Deposit", "bow-withdraw": "AMM Withdraw", "tc-swap": "Market Order",
    "ghost-borrow": "Borrow", "ghost-repay": "Repay", "ghost-lend": "Lend", "ghost-withdraw": "Withdraw Lend", "ghost-credit-create": "Credit Account", "ghost-credit-action": "Credit Action",
    "ghost-credit-borrow": "Credit Borrow", "ghost-credit-repay": "Credit Repay", "ghost-credit-send": "Credit Send", "ghost-credit-exec": "Credit Execute", "ghost-liquidation": "Liquidation",
    "calc-init": "DCA Create", "calc-process": "DCA Execute", "calc-withdraw": "DCA Withdraw", "calc-create": "DCA Strategy", "calc-internal": "DCA (step)", "calc-update": "DCA Update",
    "auto-workflow": "Auto Workflow", "auto-cancel": "Cancel Workflow", "auto-config": "Auto Config", "auto-fee-wd": "Auto Fee WD", "deferred-exec": "Deferred Exec", "crank-fee": "Crank Fee",
    "ruji-stake": "RUJI Stake", "ruji-unstake": "RUJI Unstake", "ruji-claim": "RUJI Claim", "pilot-swap": "Liquidation Swap", "pilot-order": "Liquidation Bid", "liquidy-swap": "Liquidy Swap",
    "liquidy-exec": "Liquidy Execute", "brune-swap": "BRUNE Swap", "brune-mint": "BRUNE Mint", "brune-burn": "BRUNE Burn", "brune-bond": "BRUNE Bond", "brune-fee": "BRUNE Fee",
    "nami-deposit": "Index Deposit", "nami-withdraw": "Index Withdraw", "revenue-run": "Revenue Dist", "merge-deposit": "Merge", "merge-withdraw": "Merge Out", "secure": "Secure",
    "tcy_stake": "TCY Stake", "tcy_unstake": "TCY Unstake",
}


def incidents(spark: SparkSession) -> DataFrame:
    """(address, chain, incident, estimated_usd, date, source) of known incidents."""
    return spark.createDataFrame(list(INCIDENTS), "address string, chain string, incident string, estimated_usd bigint, date string, source string")


def frozen_baseline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FROZEN), "address string, chain string")


def contracts(spark: SparkSession) -> DataFrame:
    """The dimension of known contracts; small enough to broadcast."""
    return spark.createDataFrame(list(CONTRACTS), schemas.CONTRACTS)
