"""Multi-step compositions: iteration, placement, labelling and merging."""
