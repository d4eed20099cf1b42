"""DataFrame operators: rules, catalog, voting, duplicates, tracks, boxes, evaluation."""
