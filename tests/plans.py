"""What physical plans do."""


def nodes(df):
    """The nodes of the first plan of a frame, before anything is known from running it."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        found.append(node)
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found


def names(df):
    return [node.nodeName() for node in nodes(df)]


def exchanged(df):
    """The columns that the exchanges of a plan move, one set for each."""
    return [
        {node.output().apply(i).name() for i in range(node.output().size())} for node in nodes(df) if node.nodeName() == "Exchange"
    ]
