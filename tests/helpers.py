"""Small tables that several test modules build."""


def nested(spark, items):
    rows = [(pos, i, code, desc, surface, aliases, "global") for pos, (i, code, desc, surface, aliases) in enumerate(items)]
    return spark.createDataFrame(
        rows,
        "item_pos bigint, id bigint, code string, desc string, surface string,"
        " aliases array<struct<id:bigint,surface:string>>, scope string",
    )


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")
