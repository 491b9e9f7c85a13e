import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(5)

    def text(n, of=WORDS):
        return " ".join(rng.choice(of) for _ in range(n))

    return text
