def test_registered():
    from __spark_entry__ import queries
    assert {"pipeline", "op1_bpe_encode_decode", "op9_packing"} <= set(queries())
