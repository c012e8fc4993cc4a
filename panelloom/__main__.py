from panelloom.cli import main

main()
