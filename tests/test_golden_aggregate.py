"""Commitments against values from outside: 48 sub-pieces and the root that a storage provider's tools give for them."""

from pyspark.sql import functions as F

from stowage.operators import merkle

# Commitment and raw size of each member in order, and what they add up to.
MEMBERS = """
    bafkzcibf3ck4uais4fgennh4hbfx5z3i6hue4xgq2cdeamtus4hjbsrjs5lf2azbxmsa 5010728
    bafkzcibewpkqwewyhz3yxutlxbpt2nkb6si5qilg4qqtzzij32uw7ammsc73a4wkgi 8131917
    bafkzcibftk7jmaytlewyhwwszv2ej4wws45pkn2dsquy4mfaytqap4xnaegks3nfxyhq 9986278
    bafkzcibfywz24aiswrwkb7fp3garu3xmbztlzrfs5tnjhcs2flqj2uwgmlz4226qkq5q 5465659
    bafkzcibf2wepqaytigd6ubsmcli2kcykixhxucikocupwbrtuf4ugtdrh62sm3365qbq 8387499
    bafkzcibevkergel4lcnclf654q66sb573y4hxhbgatphkv4kn7ffcdipn72nllzxey 3849046
    bafkzcibfrsfzuaisf25aejnvxcjttnilwjcwikefrggjfsllqh37ljnihkjqae7laqhq 5798516
    bafkzcibeuxfqedw2eu4aonj3b4ukwt7nbztcuqg2fkdpfd4wkmynwp6kz3cmelifde 477787
    bafkzcibftwfpqaqtfxjn372452uukqi7tdp4x7an52og64hlnec74s2zj3tetcm77q2a 10484451
    bafkzcibet6irceizvphuyaguz5duoanefmeaq4musuqrhw2bqhgvxadci4golk2idi 3880801
    bafkzcibe4xib6d3rekjzko3hjdd7uieqsvujomiwzgmbw37wtlaxbegdkg6bmsoebi 522139
    bafkzcibfsloz4ait55tlodbxeld24hsgkq74ht43zf67x7v6guuqt4wuyc74fvhlka6a 14045550
    bafkzcibevwtaqdx6g4ut7ecrl747cwbjug42wz77fvyuiisddbgmwimvxn6fai6pfa 384211
    bafkzciberdyagdtwvtywrxfjpy5ux24jug5ueuemwn63ifhl4mejfqyt2nnun2gpbe 456696
    bafkzcibf5s4n4div4c5csy26sn2embdvzgecstiytq3ksoy7ayszxqmh5gpkv7pvxelq 37774228
    bafkzcibeyd5audtir5hjskjt4nny6a4xwzvjhiaxl6ft3kdwqvxl3pvqv5r5pfvbei 340672
    bafkzcibetcrese3353i2n6itsmsw7w46v2j6iktgciovxpwrd4omdlhppqbpsakphq 15445736
    bafkzcibf632iaaiskwf2xhlnwfu3lyzkbm74basbwqkbo3g3kyxoids5a47bccrq347a 6210954
    bafkzcibexdhr6d2tl633vicwhyonakdeeom4mmsidtnkdyeljlrlseryhyob2hl7ha 522312
    bafkzcibe22equdsmjoovpxl3pixn346inodko5vbrnysy562wa4peyj3mjxkgumgbe 355114
    bafkzcibev3jaodtfvhairc2nriggnje3elsqtclurk4fpow5icitbu3umg3rgqtyeu 394962
    bafkzcibeyo7gie3mntxn3ixmm45l4s7mhsibbia762rc5kkvrkjrmfngvpphc6gkgy 14999741
    bafkzcibftd3i4bauoalbw77ytalkeugb6klfnkn2uyeeo5lh625sfvnb4375jp7liqlq 24659176
    bafkzcibeqkbxwe6qiho54ppof37nuu76prxcyvwlbcumzq7fjhrt5unatyq7zyt5ci 14630526
    bafkzcibe236asdu7b7xorgtsc6srur6yvxolxplck2vz7zdvp7smideylja2ulsece 356778
    bafkzcibfy2i2iaisb34qexxoe3npnuwnk7cqsxmtpktwymeguz6rqh3i5azb7nap4yxq 5633850
    bafkzcibftspyyaisfzettpxzxy7gaah3ebep6zvkfgjpjs7zf77s45bizqov5qgny4ga 6025316
    bafkzcibe43baief3tf4g3u22ki6ha62z3ilsrozoxcsuo4ozmsijineqrlrbrjadai 2006682
    bafkzcibeyprvsexa6gcw3zytnia3sbhijdiz747wwdqipy52etei4dohvxvycv5dei 6852157
    bafkzcibe4hvaudw6be6rvv24ahz4mvkgedvs6tutplqedznt3z5u3j7lnxs5fegjcu 342687
    bafkzcibe3w6amdvxp6so6ph5mxgpzuwrf56l2vbofiuebhust25x4b2a5c6awz5fhe 414115
    bafkzciberxyqwdqyztnvff3gtmt42rzazqmfzoz4rn7qwog3sxpyubevktyzo7xccy 325491
    bafkzcibeyhpa4drujqcnxr6ganqeftr2ciercnw6d6isf6oxrlvgybjcds4kntm2hy 278719
    bafkzcibey2caudq2czqzepa4uetgmij2fyduuoqqfsb4yrxc6zs5dbezbdwekjl7em 355770
    bafkzcibeyxbqidujg3wtyvdj2atcwvewnw77lsclxrrmnv46ld2kgpymtpnwde2kby 446011
    bafkzcibftgtl6aiscrvsdksvsa3col6ldac3l46ate46ejfuv4yrvfcexqpzz4sipu5a 5188839
    bafkzcibe2gcasdqhjhgu2qutb6spdhubprphxbctw2sic7vqqnzqsqe4ek6exekiea 372143
    bafkzcibezlwacdqh4nyegflo3xgwcklxyhx5ruegaxbpq23j5n3mn4kzm2mb6taaba 489910
    bafkzcibe4giq4dt5s3awr2q34dts65jpxnu2jahhtaxhsu24zkdkpvtg3glst5rcbe 288543
    bafkzcibe6seq4dsse5ew5skh7ezdjtclssbwistmfskjvd225ga2mgwduijfng5nai 289548
    bafkzcibes7ovwexuvh53yspakcsz5gkc33ims7nulnzd42hqqyxt4hysatpv472qay 6820201
    bafkzcibe2hgqsdua2qmm5b7zbfixiqrtdprrnopcxqelzhqc36pjii63hmabid37ey 362799
    bafkzcibeqkfq2dtbysct4sejjwsqdc4o4cgqsrxfsb5ivkiyekeerupvbkasy3sifu 305790
    bafkzcibesglu2ei4xsq4aooosjtik5rptmba3upyioneh22lmdqewzjo7fnfuxdlei 2897007
    bafkzcibew3zxaekghnmvngmbecktrbrfxqdo4vwo4mmyscc5tljc263nzllrwdfgei 2311754
    bafkzcibfshj4kaisomxcki7suzkg6zi4jirpmxyc4s6gr26qqnoaypp2gj6mvqmoteqa 5084783
    bafkzcibesd4qsdvskid22citxzhcrlnolqhbor2fg3sgfdrqf2r55atu6iuqxql4de 357232
    bafkzcibf2cdncaisijfollen3dy2fixtvcc4bamyka34dxq6usgw4xyuarsek3ktcira 4897968
"""
ROOT = "bafkzcibf7cvzwcqxm5cdi3s3pavdxy65bylec3rho3frrrx4f2wc7e4jxaofhsvku4gq"
RAW_SIZE = 244918792


def members(spark):
    rows = [(i, cid, int(size)) for i, (cid, size) in enumerate(x.split() for x in MEMBERS.split("\n") if x.strip())]
    given = spark.createDataFrame(rows, "place long, cid string, size long")
    decoded = merkle.decode_commitments(given, "cid").withColumnRenamed("id", "cid")
    return given, decoded


def test_decoded_sizes(spark):
    given, decoded = members(spark)
    got = given.join(decoded.select("cid", F.expr("padded div 128 * 127 - padding").alias("found")), "cid").collect()
    assert len(got) == 48 and all(r.found == r.size for r in got)


def aggregate(spark, order):
    given, decoded = members(spark)
    joined = given.join(decoded.select("cid", "height", "root"), "cid")
    rows = joined.select(F.lit(1).alias("key"), F.expr(order).alias("order"), "height", F.col("root").alias("node"), F.col("size").alias("raw_size"), F.col("cid").alias("id"))
    r = merkle.aggregate_roots(rows).first()
    return r, merkle.encode_commitment(r.padding, r.height, bytes.fromhex(r.root)), {x.cid: x.height for x in decoded.collect()}


def test_root_of_the_aggregate(spark):
    r, commitment, height = aggregate(spark, "place")
    assert (r.n_members, r.raw_size, commitment) == (48, RAW_SIZE, ROOT)
    assert [height[i] for i in r.ids] == sorted(height.values(), reverse=True)


def test_the_order_given_back_gives_the_same_root(spark):
    reverse, commitment, _ = aggregate(spark, "-place")
    place = {cid: i for i, cid in enumerate(reverse.ids)}
    again = aggregate(spark, "CASE cid " + " ".join(f"WHEN '{cid}' THEN {i}" for cid, i in place.items()) + " END")
    assert again[0].ids == reverse.ids and again[1] == commitment


def test_stored_roots_are_checked_against_the_members(spark):
    """The root that came with the aggregate holds, another one and one of other members don't."""
    given, decoded = members(spark)
    rows = given.join(decoded.select("cid", "height", "root"), "cid").select("place", "height", F.col("root").alias("node"), F.col("size").alias("raw_size"), F.col("cid").alias("id"))
    trees = rows.withColumn("key", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).where("key <> 3 OR place <> 7").withColumnRenamed("place", "order")
    golden = merkle._decode(ROOT)[2].hex()
    stored = spark.createDataFrame([(1, golden), (2, "0" * 64), (3, golden), (4, golden)], "key int, root string")
    got = {r.key: r.ok for r in merkle.check_roots(stored, trees).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_replay_computes_changed_trees_only(spark):
    given, decoded = members(spark)
    rows = given.join(decoded.select("cid", "height", "root"), "cid").select(F.col("place").alias("order"), "height", F.col("root").alias("node"), F.col("size").alias("raw_size"), F.col("cid").alias("id"))
    trees = rows.withColumn("key", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = merkle.member_digests(trees).withColumn("root", F.lit("kept"))
    again, computed = merkle.replay_roots(trees.where("key = 1 OR order <> 3"), kept)
    assert [r.key for r in computed.collect()] == [2] and {r.key: r.root == "kept" for r in again.collect()} == {1: True, 2: False}
