"""The reference's one documented user row (uid 38926), months 8-11."""

GOLDEN = {
    "uid": 38926, "age": 35, "sex": 1, "limit": 5.9746772897, "loanSum": 0.0,
    "clickNum": [63, 28, 23, 27],
    "clickPage": ["7:1;1:20;10:39;9:3", "7:1;1:2;10:25", "7:1;10:13;1:6;9:3", "7:2;10:22;1:3"],
    "clickPageParam": ["1_45:3", "1_45:1", "1_45:2;10_28:10", "1_45:1"],
    "clickParam": ["", "", "", ""],
    "orderNum": [8, 10, 4, 16],
    "orderAmount": [34.006860179, 15.784738593500002, 5.0421592019000006, 41.53465160670001],
    "discountAmount": [7.8398293686, 10.7899445565, 4.9075818112, 9.7621016894],
    "avgDiscount": [0.979978671075, 1.07899445565, 1.2268954528, 0.6101313555875],
    "amountByCateId": ["44:34.006860179",
                       "23:3.4454124646000004;44:1.3560182436000003;40:1.3287788709;1:9.654529014400001",
                       "9:5.0421592019000006", "40:9.6405797243;1:26.473028617100002;9:5.4210432653"],
    "loanNum": [0, 0, 0, 0], "loanAmount": [0.0, 0.0, 0.0, 0.0], "avgLoanPerPlan": [0.0, 0.0, 0.0, 0.0],
}


def golden_wide(spark):
    import datetime as dt
    from featloom.schemas import DEFAULT_PERIODS, WIDE_METRICS
    g = GOLDEN
    row = [g["uid"], g["age"], g["sex"], dt.date(2016, 1, 1), g["limit"]]
    fields = ["uid long", "age int", "sex int", "active_date date", "limit double"]
    for m in WIDE_METRICS:
        for i, p in enumerate(DEFAULT_PERIODS):
            v = g[m][i]
            row.append(v)
            t = "string" if isinstance(v, str) else ("long" if isinstance(v, int) else "double")
            fields.append(f"{m}{p} {t}")
    row.append(g["loanSum"])
    fields.append("loanSum double")
    return spark.createDataFrame([tuple(row)], ", ".join(fields))
