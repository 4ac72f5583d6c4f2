import re

from sectorline.llm import pii


def test_assigned_secrets_are_replaced(spark):
    hexed, base = "3f786850e387550fdab836ed7e6dc881de23001b", "c2VjcmV0LXZhbHVlLTEyMzQ1Njc4OTA="
    vendor = "sk_live_abcDEF0123456789xyz"
    text = f'token = "{hexed}"\napi_key: {base}\nPASSWORD=\'{hexed}\' key = {vendor} or {vendor}; key: internationalisation'
    rows = pii.replaced(spark.createDataFrame([(1, text), (2, f"token: {hexed[::-1]}")], "doc_id long, text string"))
    new = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert hexed not in new[1] and base not in new[1] and vendor not in new[1] and hexed[::-1] not in new[2]
    first, second = re.search(r'^token = "([0-9a-f]{40})"\napi_key: [A-Za-z0-9]{31}=\nPASSWORD=\'([0-9a-f]{40})\' ', new[1]).groups()
    assert first == second
    a, b = re.search(r" key = (sk_live_\w+) or (sk_live_\w+); key: internationalisation$", new[1]).groups()
    assert a == b
