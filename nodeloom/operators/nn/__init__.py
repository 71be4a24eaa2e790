"""Message-passing networks on packed graphs, in numpy inside Spark tasks."""
