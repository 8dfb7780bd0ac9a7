import random

from kithloom.operators.order import nth_smallest


def test_nth_smallest(frame):
    numbers = random.Random(2).sample(range(1, 5001), 300)
    df = frame([(x,) for x in numbers], "slot long")
    for n in (1, 2, 150, 300):
        assert nth_smallest(df, "slot", n, 5000, 7) == sorted(numbers)[n - 1] == nth_smallest(df, "slot", n, 5000)
