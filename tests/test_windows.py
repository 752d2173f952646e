from hushline.operators.windows import causal_windows


def greedy(tokens, budget):
    used, window, out = 0, 0, []
    for t in tokens:
        if used and used + t > budget:
            used, window = 0, window + 1
        used += t
        out.append(window)
    return out


def test_oversize_line_is_its_own_window(spark):
    sizes = {1: [5, 300, 5, 5], 2: [264], 3: [200, 64, 1], 4: [300, 300]}
    df = spark.createDataFrame([(c, i + 1, t) for c, x in sizes.items() for i, t in enumerate(x)], "conv_id int, line_no int, tokens int")
    got = {(r.conv_id, r.line_no): r.window_id for r in causal_windows(df).collect()}
    assert got == {(c, i + 1): w for c, x in sizes.items() for i, w in enumerate(greedy(x, 264))}
