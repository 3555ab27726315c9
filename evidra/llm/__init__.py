"""Training-data operators: licences, personal data, near duplicates, packing, mixing, URL rules,
substring duplicates, quality, embedding duplicates, secrets, hash trees, token files and ranked search. Nothing outside this folder imports it."""
