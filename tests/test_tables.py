from chainweave.sources import legacy, tables


def test_airr_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c1", "TRA", True, 3.0, "CAF", None), ("c2", None, False, None, None, "TRBV1")], "cell_id string, locus string, productive boolean, umi_count double, junction_aa string, v_call string")
    tables.write_airr(df, str(tmp_path / "x"))
    got = {r.cell_id: r for r in tables.read_airr(spark, str(tmp_path / "x")).collect()}
    assert got["c1"].umi_count == 3 and got["c1"].productive is True and got["c2"].productive is False and got["c2"].junction_aa is None


def test_10x_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("barcode,is_cell,contig_id,high_confidence,chain,v_gene,d_gene,j_gene,c_gene,productive,cdr3,cdr3_nt,reads,umis\n"
                 "A,True,A_1,True,TRB,TRBV1,None,TRBJ1,TRBC1,True,CASF,TGT,34,2\nA,True,A_2,False,TRA,TRAV1,,TRAJ1,,True,CAF,TGT,4,1\nB,TRUE,B_1,TRUE,Multi,None,None,None,None,None,None,None,1,1\n")
    got = tables.read_10x_vdj(spark, str(p)).orderBy("cell_id").collect()
    assert [(r.cell_id, r.locus, r.v_call, r.d_call, r.productive, r.umi_count) for r in got] == [("A", "TRB", "TRBV1", None, True, 2), ("B", "Multi", None, None, False, 1)]
    assert tables.read_10x_vdj(spark, str(p), filtered=False).count() == 3


def test_10x_json(spark, tmp_path):
    p = tmp_path / "a.json"
    region = lambda kind, chain, name, a, b: f'{{"contig_match_start":{a},"contig_match_end":{b},"feature":{{"chain":"{chain}","gene_name":"{name}","region_type":"{kind}"}}}}'
    own = ",".join([region("L-REGION+V-REGION", "TRB", "TRBV1", 0, 300), region("D-REGION", "TRB", "TRBD1", 305, 312), region("J-REGION", "TRB", "TRBJ1", 315, 360)])
    p.write_text(f'[{{"barcode":"A","contig_name":"A_1","is_cell":true,"high_confidence":true,"productive":true,"cdr3":"CF","cdr3_seq":"TGTTTT","umi_count":2,"read_count":9,"annotations":[{own}]}}]')
    r = tables.read_10x_vdj(spark, str(p)).first()
    assert (r.locus, r.v_call, r.d_call, r.c_call, r.np1_length, r.np2_length) == ("TRB", "TRBV1", "TRBD1", None, 5, 3)


def test_bracer_and_bd(spark, tmp_path):
    p = tmp_path / "b.tab"
    p.write_text("CELL\tSEQUENCE_ID\tLOCUS\tFUNCTIONAL\tV_CALL\tD_CALL\tJ_CALL\tC_CALL\tV_SEQ_START\tV_SEQ_LENGTH\tD_SEQ_START\tD_SEQ_LENGTH\tJ_SEQ_START\tJ_SEQ_LENGTH\tJUNCTION\tTPM\n"
                 "x\tx1\tH\tTrue\tIGHV1\tIGHD1\tIGHJ1\tIGHA1*01\t16\t299\t333\t8\t339\t44\tTGTTGG\t8.5\nx\tx2\tK\tFalse\tIGKV1\tNone\tIGKJ1\tNone\t1\t100\tNone\tNone\t105\t30\tNone\t2\n")
    got = {r.sequence_id: r for r in tables.read_bracer(spark, str(p)).collect()}
    assert (got["x1"].locus, got["x1"].c_call, got["x1"].np1_length, got["x1"].np2_length, got["x1"].junction_aa) == ("IGH", "IGHA1", 18, -2, "CW")
    assert (got["x2"].np1_length, got["x2"].np2_length, got["x2"].junction_aa, got["x2"].productive) == (4, None, None, False)
    q = tmp_path / "d.csv"
    q.write_text("## comment\nCell_Index,Chain_Type,V_gene_Dominant,D_gene_Dominant,J_gene_Dominant,C_gene_Dominant,CDR3_Nucleotide_Dominant,CDR3_Translation_Dominant,Productive,Read_Count,Molecule_Count\n7,BCR_Lambda,IGLV1,,IGLJ1,,TGT,C,True,5,2\n")
    r = tables.read_bd_rhapsody(spark, str(q)).first()
    assert (r.cell_id, r.locus, r.v_call, r.umi_count) == ("7", "IGL", "IGLV1", 2)


def test_legacy(spark):
    df = spark.createDataFrame([("a", "TRA", "CAF", "nan", "None", '[{"locus":"TRB","junction_aa":"CX"}]'), ("b", None, None, "TRA", None, None)],
                               "cell_id string, IR_VJ_1_locus string, IR_VJ_1_junction_aa string, IR_VJ_2_locus string, IR_VJ_2_junction_aa string, extra_chains string")
    got = sorted((r.cell_id, r.slot, r.locus, r.junction_aa) for r in legacy.upgrade_schema(df).collect())
    assert got == [("a", 0, "TRB", "CX"), ("a", 1, "TRA", "CAF"), ("b", 2, "TRA", None)]
