"""Query names of this subpackage, and the DuckDB twins of those that SQL can express."""

from growmap.llm import chat, classifier, decontaminate, html, mixing, outliers, sharding, simhash, tokens, warc

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_chat": chat.op2,
    "op3_quality": classifier.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_tokens": tokens.op5,
    "op6_sharding": sharding.op6,
    "op7_warc": warc.op7,
    "op8_outliers": outliers.op8,
    "op9_simhash": simhash.op9,
    "op10_html": html.op10,
    "op4_near": decontaminate.op4_near,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op2_chat": chat.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op4_near": decontaminate.NEAR_SQL,
    "op6_sharding": sharding.SQL,
    "op7_warc": warc.SQL,
    "op8_outliers": outliers.SQL,
    "op9_simhash": simhash.SQL,
}
