"""Estimation goes on until all chances stand still."""

from gridloom.llm import weaksup


def test_mostly_good_documents_do_not_end_the_estimation():
    one = (1,) * 8
    patterns = sorted([(one, 99000), ((-1,) + one[1:], 300), ((-1, 0) + one[2:], 200), ((-1, -1, 0) + one[3:], 200), ((-1, -1, 1, 1, 1, 0, 1, 1), 100)])
    share, chance = weaksup.expectation_maximisation(patterns)
    longer = weaksup.expectation_maximisation(patterns, rounds=2000)
    early = weaksup.expectation_maximisation(patterns, rounds=2)
    assert share > 0.99 and abs(share - longer[0]) < 1e-8
    flat = lambda c: [x for rule in c for k in (1, 0) for x in rule[k].values()]
    assert max(abs(a - b) for a, b in zip(flat(chance), flat(longer[1]))) < 1e-8
    assert max(abs(a - b) for a, b in zip(flat(chance), flat(early[1]))) > 0.1
    assert weaksup.posterior((-1, -1, 0) + one[3:], share, chance) < 0.5 < weaksup.posterior(one, share, chance)
